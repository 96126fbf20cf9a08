"""Scalar expressions: codes, labels, units, change and two-digit years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import as_col, in_set, ratio

FEET_PER_MILE = 5280.0
METRES_PER_MILE = 1609.34


def prefix(c: Column | str, k: int) -> Column:
    return F.substring(as_col(c), 1, k)


def suffix(c: Column | str, n: int) -> Column:
    return F.right(as_col(c), F.lit(n))


def strip_suffix(c: Column | str, text: str) -> Column:
    """Drop a trailing ``text`` where it is there."""
    c = as_col(c)
    return F.when(F.endswith(c, F.lit(text)), F.left(c, F.char_length(c) - len(text))).otherwise(c)


def percent_label(c: Column | str, digits: int = 1) -> Column:
    """0.123 as '12.3%'."""
    scaled = F.round(as_col(c) * 100, digits)
    return F.concat(scaled.cast(f"decimal(18,{digits})").cast("string"), F.lit("%"))


def interaction(a: Column | str, b: Column | str) -> Column:
    """One composite category from two: 'a.b'."""
    return F.concat(as_col(a).cast("string"), F.lit("."), as_col(b).cast("string"))


def classify(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First rule that holds decides; a NULL condition does not hold."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, label in rules[1:]:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out


def flag_in(c: Column | str, codes: Sequence, yes: object, no: object, prefix_len: int | None = None) -> Column:
    """``yes`` where the code (or its prefix) is listed, ``no`` elsewhere, also for missing codes."""
    key = prefix(c, prefix_len) if prefix_len else as_col(c)
    return F.when(in_set(key, *codes), F.lit(yes)).otherwise(F.lit(no))


def normalize_codes(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace listed code variants; leave all others."""
    out = as_col(c)
    if not mapping:
        return out
    items = list(mapping.items())
    ladder = F.when(out == items[0][0], F.lit(items[0][1]))
    for old, new in items[1:]:
        ladder = ladder.when(out == old, F.lit(new))
    return ladder.otherwise(out)


def bucketize(c: Column | str, breaks: Sequence[float]) -> Column:
    """1-based class of a value among fixed breaks: [b1,b2), [b2,b3), …, last class closed; NULL outside."""
    c = as_col(c)
    last = len(breaks) - 1
    out = F.when(c < breaks[0], F.lit(None).cast("int"))
    for i in range(1, last):
        out = out.when(c < breaks[i], F.lit(i))
    return out.when(c <= breaks[last], F.lit(last))


def change(new: Column | str, old: Column | str) -> Column:
    return as_col(new) - as_col(old)


def pct_change(new: Column | str, old: Column | str) -> Column:
    return ratio(as_col(new) - as_col(old), old)


def year_from_yy(c: Column | str, max_yy: int) -> Column:
    """Two-digit text year: up to ``max_yy`` is 20yy, above is 19yy."""
    yy = as_col(c).try_cast("int")
    return F.when(yy <= max_yy, yy + 2000).otherwise(yy + 1900)


def to_sqmi(sqft: Column | str) -> Column:
    return as_col(sqft) / (FEET_PER_MILE * FEET_PER_MILE)


def to_miles(feet: Column | str) -> Column:
    return as_col(feet) / FEET_PER_MILE


def metres_to_miles(metres: Column | str) -> Column:
    return as_col(metres) / METRES_PER_MILE


def wrap_degrees(c: Column | str) -> Column:
    """Bearing cut to whole degrees, values up to 0 moved into 1..360."""
    whole = as_col(c).cast("int")
    return F.when(whole <= 0, whole + 360).otherwise(whole)
