"""Secret scan: known key shapes, and runs of characters with a high Shannon entropy in a sliding window.

Everything is one projection of built-in functions: no shuffle, and no state beyond one text. A match's place is the
length of all that ``split`` leaves before it plus the matches before it. The entropy of a window is kept as the
integer sum of f(n) = n log2 n over its character counts; a step changes it only by the counts of the character that
enters and of the one that leaves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in their order, with the pattern and, for ``assign``, the shortest second group.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 12
# A shorter run of either kind holds no longer match, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
UNIT = 1 << 20
#: Least bits per character in a window, by the smallest character class that holds the whole candidate, or the whole PART
#: if the window lies within one: a value is judged behind a name or path as it would be alone, by the allow-list too.
CLASS_BITS = (("^[0-9A-Fa-f]+$", 3.0), ("^[0-9A-Za-z]+$", 3.7), ("", 3.9))
_RUN = "[A-Za-z0-9+/_=-]"
#: A candidate is a whole run of at least WINDOW characters with a letter and a digit.
CANDIDATE = rf"(?<!{_RUN})(?={_RUN}*[0-9])(?={_RUN}*[A-Za-z]){_RUN}{{{WINDOW},}}+"
PART = "^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z]+$"
#: A part that may hold a whole window.
LONG_PART = r"(?<![0-9A-Za-z])(?=[0-9A-Za-z]*[0-9])(?=[0-9A-Za-z]*[A-Za-z])[0-9A-Za-z]{%d}"
#: Candidates and parts that are no secrets: UUIDs, dates and times, words joined by separators, placeholders, data-free runs.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^\d{4}-\d\d-\d\d([T_-]\d\d-?\d\d-?\d\d)?Z?$",
    r"^/?([A-Za-z]+|\d{1,4})([/_=+-]+([A-Za-z]+|\d{1,4}))*/?$",
    r"(?i)example|sample|dummy|placeholder|changeme|x{6,}|0{8,}|1234567",
)


def _terms(window: int) -> list[int]:
    """f(n) for n = 0 … window, in units of 2^-20."""
    return [round(n * math.log2(n) * UNIT) if n else 0 for n in range(window + 1)]


def entropy_limit(bits: float, window: int = WINDOW) -> int:
    """The largest sum of f(n) that a window with at least ``bits`` per character can have."""
    return math.floor(window * (math.log2(window) - bits) * UNIT)


_SPANS = "array<struct<s:int,e:int>>"


def _places(text: Column, pattern: str) -> Column:
    """array<struct<s,e>> of all matches, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    start = F.lit(0).alias("pos"), F.array().cast(_SPANS).alias("out")

    def step(acc, x):
        s = acc["pos"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.struct(
            e.alias("pos"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out")
        )

    pairs = F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    folded = F.aggregate(pairs, F.struct(*start), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), folded).otherwise(F.array().cast(_SPANS))


def _assign_places(text: Column) -> Column:
    kept = F.zip_with(
        _places(text, ASSIGN),
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)),
        lambda span, value: F.when(F.length(value) >= ASSIGN_VALUE, span),
    )
    return F.when(text.rlike(ASSIGN), F.filter(kept, lambda x: x.isNotNull())).otherwise(F.array().cast(_SPANS))


def _class_limit(candidate: Column, window: int) -> Column:
    limit = None
    for pattern, bits in reversed(CLASS_BITS):
        value = F.lit(entropy_limit(bits, window))
        limit = value if limit is None else F.when(candidate.rlike(pattern), value).otherwise(limit)
    return limit


def _is_allowed(value: Column, allowed: Sequence[str]) -> Column:
    clean = F.lit(False)
    for pattern in allowed:
        clean = clean | value.rlike(pattern)
    return clean


def entropy_runs(candidate: Column, window: int = WINDOW, allowed: Sequence[str] = ()) -> Column:
    """Unions of the windows of ``candidate`` with enough entropy, as array<struct<s,e>> within it.

    A window inside a part with letters and digits goes by the part's class and whether the part is allowed, any other by the
    candidate's.
    """
    terms = F.array(*[F.lit(t) for t in _terms(window)])

    def judged(value):  # no window has a negative sum
        return F.when(_is_allowed(value, allowed), -1).otherwise(_class_limit(value, window))

    limit = judged(candidate)
    pieces = F.regexp_extract_all(candidate, F.lit("[0-9A-Za-z]+|[^0-9A-Za-z]+"), F.lit(0))
    own = F.flatten(F.transform(
        pieces, lambda p: F.array_repeat(F.when(p.rlike(PART), judged(p)).otherwise(limit), F.length(p))
    ))

    def times(held, char):
        return F.length(held) - F.length(F.replace(held, char, F.lit("")))

    def term(n):
        return F.element_at(terms, n + 1)

    def step(acc, x):
        char = x["char"]
        full = F.length(acc["held"]) == window
        leaving = F.substring(acc["held"], 1, 1)
        out = F.when(full, term(times(acc["held"], leaving)) - term(times(acc["held"], leaving) - 1)).otherwise(0)
        rest = F.when(full, F.substring(acc["held"], 2, window)).otherwise(acc["held"])
        return F.struct(
            F.concat(rest, char).alias("held"),
            (acc["sum"] - out + term(times(rest, char) + 1) - term(times(rest, char))).alias("sum"),
            (acc["pos"] + 1).alias("pos"),
            F.when(char.rlike("[0-9A-Za-z]"), acc["tail"] + 1).otherwise(0).alias("tail"), x["own"].alias("own"),
            acc["limit"].alias("limit"), acc["s"].alias("s"), acc["e"].alias("e"), acc["runs"].alias("runs"),
        )

    def flag(acc):
        hit = (F.length(acc["held"]) == window) & (acc["sum"] <= F.when(acc["tail"] >= window, acc["own"]).otherwise(acc["limit"]))
        begins = hit & (acc["e"] < acc["pos"] - window)
        closed = F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e")))
        return F.struct(
            acc["held"].alias("held"), acc["sum"].alias("sum"), acc["pos"].alias("pos"), acc["tail"].alias("tail"),
            acc["own"].alias("own"), acc["limit"].alias("limit"),
            F.when(begins, acc["pos"] - window).otherwise(acc["s"]).alias("s"),
            F.when(hit, acc["pos"]).otherwise(acc["e"]).alias("e"),
            F.when(begins & (acc["e"] > 0), F.concat(acc["runs"], closed)).otherwise(acc["runs"]).alias("runs"),
        )

    start = F.struct(
        F.lit("").alias("held"), F.lit(0).alias("sum"), F.lit(0).alias("pos"), F.lit(0).alias("tail"),
        F.lit(0).alias("own"), limit.alias("limit"),
        F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.array().cast(_SPANS).alias("runs"),
    )

    def last(acc):
        closed = F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e")))
        return F.when(acc["e"] > 0, F.concat(acc["runs"], closed)).otherwise(acc["runs"])

    chars = F.filter(F.split(candidate, ""), lambda c: c != "")
    marked = F.zip_with(chars, own, lambda c, n: F.struct(c.alias("char"), n.alias("own")))
    return F.aggregate(marked, start, lambda acc, x: flag(step(acc, x)), last)


def _entropy_places(text: Column, allowed: Sequence[str], window: int) -> Column:
    def runs(span):
        candidate = F.substring(text, span["s"] + 1, span["e"] - span["s"])
        clean = _is_allowed(candidate, allowed) & ~candidate.rlike(LONG_PART % window)
        inside = F.transform(
            entropy_runs(candidate, window, allowed),
            lambda r: F.struct((span["s"] + r["s"]).alias("s"), (span["s"] + r["e"]).alias("e")),
        )
        return F.when(clean, F.array().cast(_SPANS)).otherwise(inside)

    return F.flatten(F.transform(_places(text, CANDIDATE), runs))


def secret_spans(
    text: Column, allowed: Sequence[str] = ALLOWED, window: int = WINDOW
) -> Column:
    """array<struct<s,k,e>> of every secret in ``text``, by start and then kind (0 … 3 as in KINDS)."""
    value = F.coalesce(text, F.lit(""))
    places = (_assign_places(value), _places(value, ACCESS), _places(value, HEX), _entropy_places(value, allowed, window))

    def tagged(spans, kind):
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))

    return F.sort_array(F.concat(*[tagged(spans, kind) for kind, spans in enumerate(places)]))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ","
    )


def scan_secrets(
    docs: DataFrame, text: str = "text", allowed: Sequence[str] = ALLOWED, window: int = WINDOW
) -> DataFrame:
    """``docs`` with ``secret_spans``: array<struct<s,k,e>>.

    NULL and empty texts have no span. Repeated rows get the same spans. A column of that name is replaced. A text of
    any length is scanned whole; an allow-listed candidate gives entropy spans only inside parts that are not allow-listed
    themselves, and never takes a base span away.
    """
    return docs.withColumn("secret_spans", secret_spans(F.col(text), allowed, window))


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` masked; overlapping and touching spans become one mask.

    NULL texts stay NULL, texts without secrets stay as they are. Columns and rows are those of ``docs``.
    """
    merged = F.aggregate(
        F.col("secret_spans"),
        F.array().cast(_SPANS),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["s"] <= F.element_at(acc, -1)["e"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(
                    F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")
                )),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))),
    )
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    value = F.col(text)
    masked = F.aggregate(
        F.col("merged_spans"), start,
        lambda acc, x: F.struct(
            x["e"].alias("pos"),
            F.concat(acc["out"], F.substring(value, acc["pos"] + 1, x["s"] - acc["pos"]), F.lit(mask)).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(value, acc["pos"] + 1, F.length(value))),
    )
    return (
        scan_secrets(docs, text).withColumn("merged_spans", merged)
        .withColumn(text, F.when(F.size("merged_spans") > 0, masked).otherwise(value))
        .select(*docs.columns)
    )
