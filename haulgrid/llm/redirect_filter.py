"""URL filter: host and path rules, and block decisions that follow redirects and canonical links.

Links are read from the pages' markup. URLs tied by links in either direction form one class (connected components).
A URL's own rule always holds. Other URLs take the class's decision: allow if any URL of the class is explicitly
allowed, else block if any is blocked. A link's target counts even if it is no page of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import write_table

#: Verdict, host and path of each rule.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DEFAULT = "allow"

_ATTRIBUTE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_CANONICAL = r"""(?is)<link\b(?=[^>]*\srel\s*=\s*["']?canonical["'\s/>])[^>]*>"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\shttp-equiv\s*=\s*["']?refresh["'\s/>])[^>]*>"""


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    return F.coalesce(_lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else NULL; the first listed of two equally long ones."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, under in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        found = F.when(fits, F.struct(F.lit(at + under).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_key(url: Column) -> Column:
    """What makes two spellings one URL: scheme and host in lower case, an empty path as /, no fragment."""
    scheme = _lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    path = url_path(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(
        url.contains("://"), F.concat(scheme, F.lit("://"), url_host(url), F.when(path == "", "/").otherwise(path), query)
    )


def resolve(base: Column, link: Column) -> Column:
    """The absolute URL of a link found on the page ``base``; NULL where there is none."""
    link = F.trim(link)
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    return (
        F.when(link.isNull() | (link == "") | link.startswith("#"), None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, url_path(base), link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): the page's URL and the target of each of its refreshes and canonical links, as URL keys."""
    def attribute(tag, name):
        raw = F.regexp_extract(tag, rf"(?is)\s{name}{_ATTRIBUTE}", 1)
        return F.replace(F.regexp_replace(raw, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&"))

    canonical = F.transform(F.regexp_extract_all(F.col(html), F.lit(_CANONICAL), F.lit(0)), lambda t: attribute(t, "href"))
    refresh = F.transform(
        F.regexp_extract_all(F.col(html), F.lit(_REFRESH), F.lit(0)),
        lambda t: F.regexp_replace(
            F.regexp_extract(attribute(t, "content"), r"(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*(.*)$", 1), r"""^["']|["']$""", ""
        ),
    )
    has = F.col(html).rlike(_CANONICAL) | F.col(html).rlike(_REFRESH)
    return (
        pages.filter(has).select(F.col(url).alias("__base"), F.explode(F.concat(canonical, refresh)).alias("__link"))
        .select(url_key(F.col("__base")).alias("u"), url_key(resolve(F.col("__base"), F.col("__link"))).alias("v"))
        .filter("u is not null and v is not null and u <> v").distinct()
    )


def class_verdicts(links: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(__key, __class_verdict) of every URL in ``links`` whose class holds a rule's decision."""
    classes = connected_components(links)
    members = classes.unionByName(
        classes.select(F.col("component").alias("node"), "component").distinct()
    )
    rule = match_rule(url_host(F.col("node")), url_path(F.col("node")), rules)["verdict"]
    decided = (
        members.withColumn("own", rule).groupBy("component")
        .agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
        .filter("allowed or blocked")
        .select("component", F.when(F.col("allowed"), "allow").otherwise("block").alias("__class_verdict"))
    )
    return members.join(decided, "component").select(F.col("node").alias("__key"), "__class_verdict")


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html",
    default: str = DEFAULT,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    A NULL url, or one without ``://``, has empty host and path, no rule and no class: the default verdict. NULL html has
    no links. Repeated pages and repeated links get the same verdict; an empty table gives an empty table. Only URLs
    travel, never the markup, and only if any page has a link.
    """
    links = write_table(page_links(pages, url, html), "links")
    out = (
        pages.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
        .withColumn("__rule", match_rule(F.col("host"), F.col("path"), rules))
        .withColumn("rule", F.col("__rule.rule"))
    )
    if links.isEmpty():
        return out.withColumn("verdict", F.coalesce("__rule.verdict", F.lit(default))).drop("__rule")
    # pages that a rule decides, or without a URL, take no part in the join: no key stands for many of them
    follows = F.col("__rule").isNull() & F.col(url).isNotNull()
    loose = out.filter(follows).withColumn("__key", url_key(F.col(url)))
    fixed = out.filter(~follows).withColumn("verdict", F.coalesce("__rule.verdict", F.lit(default)))
    followed = (
        loose.join(class_verdicts(links, rules), "__key", "left")
        .withColumn("verdict", F.coalesce("__class_verdict", F.lit(default))).drop("__key", "__class_verdict")
    )
    return fixed.unionByName(followed.select(*fixed.columns)).drop("__rule")
