"""The registered query of every operator, over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptive_scan, crf_extract, golay_simhash, grouped_packing, language_bits, pairwise_quality, parity_join, raking
from . import rtree_negatives, suffix_repetition, variant_groups
from . import entropy_secrets as secrets
from . import redirect_filter as urls
from .tables import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _secret_sql() -> str:
    """All spans from scratch: every window of every candidate is counted anew."""
    def places(kind, pattern, keep="TRUE"):
        return f"""
SELECT doc_id, {kind} AS k, s, s + length(m) AS e, m FROM (
  SELECT doc_id, m, sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT doc_id, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM texts))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {keep}"""

    q = lambda s: s.replace("'", "''")
    assign = q(secrets.ASSIGN).replace(r"\x20", " ")
    run = "[A-Za-z0-9+/_=-]"
    limit = "CASE " + " ".join(
        f"WHEN regexp_matches(judged, '{p}') THEN {secrets.entropy_limit(b)}" for p, b in secrets.CLASS_BITS
    ) + " END"
    terms = "[" + ", ".join(map(str, secrets._terms(secrets.WINDOW))) + "]"
    clean = " OR ".join(f"regexp_matches(judged, '{q(p)}')" for p in secrets.ALLOWED)
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({places(0, assign, f"length(regexp_extract(m, '{assign}', 2)) >= {secrets.ASSIGN_VALUE}")}
  UNION ALL {places(1, "AKIA[A-Z0-9]+", "length(m) >= 18")} UNION ALL {places(2, "[0-9a-f]+", "length(m) >= 16")}),
candidates AS (SELECT * FROM ({places(3, run + "+", f"length(m) >= {secrets.WINDOW}")})
  WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')),
slid AS (SELECT doc_id, s, m, n, m[n + 1:n + {secrets.WINDOW}] AS w
  FROM (SELECT *, unnest(range(length(m) - {secrets.WINDOW - 1})) AS n FROM candidates)),
parts AS (SELECT *, CASE WHEN regexp_matches(w, '^[0-9A-Za-z]+$')
  THEN regexp_extract(m[:n], '[0-9A-Za-z]*$') || w || regexp_extract(m[n + {secrets.WINDOW} + 1:], '^[0-9A-Za-z]*') END AS part FROM slid),
windows AS (SELECT *, CASE WHEN regexp_matches(part, '[0-9]') AND regexp_matches(part, '[A-Za-z]') THEN part ELSE m END AS judged FROM parts),
hits AS (SELECT doc_id, s AS c, s + n AS s, s + n + {secrets.WINDOW} AS e FROM windows
  WHERE list_sum(list_transform(map_values(list_histogram(string_split(w, ''))), lambda x: {terms}[CAST(x + 1 AS BIGINT)])) <= {limit}
    AND NOT ({clean})),
runs AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, c ORDER BY s) AS g FROM (
    SELECT *, CASE WHEN s > lag(e) OVER (PARTITION BY doc_id, c ORDER BY s) THEN 1 ELSE 0 END AS fresh FROM hits))
  GROUP BY doc_id, c, g),
every AS (SELECT doc_id, k, s, e FROM base UNION ALL SELECT doc_id, 3, s, e FROM runs),
named AS (SELECT *, {names}[k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM every),
summed AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
    count(*) FILTER (k = 2) AS n_hex, string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS b,
    string_agg(x, ',' ORDER BY s, k, e) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN summed USING (doc_id)"""


@query()
def op1_pairwise_quality(spark, d):
    docs = _table(spark, d, "documents")
    model = pairwise_quality.train(docs, _table(spark, d, "labels"))
    scored = pairwise_quality.score(docs, model, keep=["doc_id"])
    held_out = remainder(F.col("doc_id"), pairwise_quality.FOLDS) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query()
def op2_grouped_packing(spark, d):
    import public_tokenizers

    return grouped_packing.pack(_table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op4_suffix_repetition(spark, d):
    judged = suffix_repetition.judge_repetition(_table(spark, d, "documents"), keep=["doc_id"])
    return judged.drop("repeat_spans")


@query(_secret_sql())
def op7_entropy_secrets(spark, d):
    found = secrets.scan_secrets(_table(spark, d, "documents"))
    spans = F.col("secret_spans")

    def count(kind):
        return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")

    base = secrets.spans_text(F.filter(spans, lambda x: x["k"] < 3))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), secrets.spans_text(spans).alias("spans"),
    )


_URL_PARTS = """regexp_extract(url, '^((?s:.)*?)://([^/?#]*)([^?#]*)', ['scheme', 'host', 'path'])"""


def _url_sql() -> str:
    """Rules by ranking all that fit. The driver's pages hold no link, so each page is a class of its own."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    return f"""
WITH parts AS (SELECT page_id, coalesce(translate(u.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(u.path, '') AS path FROM (SELECT page_id, {_URL_PARTS} AS u FROM pages)),
fits AS (SELECT page_id, r.h || r.p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC) AS n
  FROM parts, (VALUES {rules}) r(v, h, p) WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p))
SELECT p.page_id, host, path, rule, coalesce(v, '{urls.DEFAULT}') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1"""


@query(_url_sql())
def op8_redirect_filter(spark, d):
    judged = urls.filter_urls(_table(spark, d, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op6_parity_join(spark, d):
    return parity_join.near_duplicates(_table(spark, d, "documents"))


@query()
def op5_adaptive_scan(spark, d):
    return adaptive_scan.nearest(_table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op9_language_bits(spark, d):
    docs = _table(spark, d, "documents")
    found = language_bits.identify(docs, language_bits.train(docs), keep=["doc_id"])
    held_out = remainder(F.col("doc_id"), language_bits.FOLDS) == language_bits.HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op10_crf_extract(spark, d):
    pages = _table(spark, d, "pages")
    return crf_extract.extract(pages, crf_extract.train(pages), keep=["page_id", "url"])


def _raking_sql() -> str:
    """The same share and sweeps, written out one after the other."""
    keys = raking.DIMENSIONS
    steps, now = [], "c0"
    for i in range(raking.SWEEPS):
        for k in keys:
            new = f"c{i}_{k}"
            steps.append(f"""{new} AS (SELECT source, lang, topic, n, least(weight * coalesce(t_{k}.target
  * (SELECT sum(n) FROM c0) / nullif(sum(weight * n) OVER (PARTITION BY {k}), 0), 1.0), 1.0 / (SELECT share FROM s)) AS weight
  FROM {now} JOIN t_{k} USING ({k}))""")
            now = new
    targets = ", ".join(
        f"t_{k} AS (SELECT {k}, r / sum(r) OVER () AS target FROM (SELECT {k}, sqrt(CAST(sum(n) AS DOUBLE)) AS r FROM c0 GROUP BY {k}))"
        for k in keys
    )
    scarce = " UNION ALL ".join(
        f"SELECT sum(n) / (SELECT CAST(sum(n) AS DOUBLE) FROM c0) / target AS r FROM c0 JOIN t_{k} USING ({k}) WHERE target > 0 GROUP BY {k}, target"
        for k in keys
    )
    return f"""
WITH d AS (SELECT doc_id, text, coalesce(source, chr(0)) AS source, coalesce(lang, chr(0)) AS lang,
  coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS n_tokens FROM documents),
f AS (SELECT *, CASE WHEN contains(text, ' | ') THEN 'table' WHEN n_tokens >= {raking.LONG} THEN 'long'
  WHEN n_tokens < {raking.SHORT} THEN 'short' ELSE 'prose' END AS topic FROM d),
c0 AS (SELECT source, lang, topic, sum(n_tokens) AS n, 1.0::DOUBLE AS weight FROM f GROUP BY ALL),
{targets}, s AS (SELECT least({raking.SHARE}, {raking.HEADROOM} * min(r)) AS share FROM ({scarce}) WHERE r > 0),
{", ".join(steps)},
p AS (SELECT f.*, weight, least(weight * (SELECT share FROM s), 1.0) AS probability FROM f JOIN {now} USING (source, lang, topic))
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(weight, 6) AS weight,
  round(probability, 6) AS probability,
  CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / CAST(16 AS DOUBLE) ** 13 < probability AS sampled FROM p"""


@query(_raking_sql())
def op3_raking(spark, d):
    mixed = raking.mix_sources(_table(spark, d, "documents"))
    return mixed.select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"),
        F.col("__tokens").alias("n_tokens"), F.round("__weight", 6).alias("weight"),
        F.round("__probability", 6).alias("probability"), F.col("__sampled").alias("sampled"),
    )


def _negatives_sql() -> str:
    """Every anchor against every row."""
    order = "ORDER BY score DESC, id"
    return f"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND len(a.e) = len(b.e) AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id {order}) <= {rtree_negatives.POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same
  AND {rtree_negatives.FROM} * positive_score <= 100 * score AND 100 * score <= {rtree_negatives.TO} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id {order}) QUALIFY row_number() OVER w <= {rtree_negatives.NEGATIVES}"""


@query(_negatives_sql())
def op11_rtree_negatives(spark, d):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree_negatives.hard_negatives(_table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


@query()
def op12_golay_simhash(spark, d):
    return golay_simhash.near_duplicates(_table(spark, d, "documents"))


def _variants_sql() -> str:
    """CRC by table, then near words by one deleted code point: equal strings, or two strings equal without the same place."""
    least = variant_groups.LEAST_LENGTH
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{least},}}')) AS r FROM documents) GROUP BY ALL),
bytes AS (SELECT r, n, flatten(list_transform(string_split(concat(doc_id, ':', r), ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM runs),
hashed AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM bytes, crc),
said AS (SELECT CASE WHEN h % {variant_groups.SLIP} = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= {least} GROUP BY word
  HAVING sum(n) >= {variant_groups.LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b USING (i, d) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
first AS (SELECT word, n_near, m, min(other) AS other FROM best JOIN pairs USING (word, m) GROUP BY ALL),
forms AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {variant_groups.TIMES} * n THEN other END AS form,
  CASE WHEN m >= {variant_groups.TIMES} * n THEN m END AS form_n FROM words w LEFT JOIN first USING (word)),
paths AS (SELECT word, word AS last FROM forms UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.last WHERE f.form IS NOT NULL)
SELECT word, form, last AS root, n, n_near, form_n FROM paths JOIN forms USING (word)
WHERE last IN (SELECT word FROM forms WHERE form IS NULL)"""


@query(_variants_sql())
def op13_variant_groups(spark, d):
    return variant_groups.variants(_table(spark, d, "documents"))
