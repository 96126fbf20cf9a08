"""Filters, projections, joins, appends and top-k."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import as_col, number
from .aggregates import quantile
from .skew import beside

log = logging.getLogger(__name__)


# ---- filters -------------------------------------------------------------------------------------------


def split_null(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(rows where ``col`` is known, rows where it is missing)."""
    return df.filter(F.col(col).isNotNull()), df.filter(F.col(col).isNull())


def filter_above_quantile(df: DataFrame, col: str, p: float) -> DataFrame:
    """Rows whose value is above the exact p-quantile of the whole table."""
    return df.join(F.broadcast(quantile(df, col, p, "__q")), F.col(col) > F.col("__q")).drop("__q")


# ---- projections ---------------------------------------------------------------------------------------


def to_number(df: DataFrame, cols: Sequence[str], dtype: str = "double") -> DataFrame:
    """Coerce text columns to numbers, NULL where they are none."""
    return df.withColumns({c: number(c, dtype) for c in cols})


def snake(name: str) -> str:
    """Header text to a snake_case identifier."""
    text = name.replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()
    return f"x{text}" if not text or text[0].isdigit() else text


def clean_names(df: DataFrame) -> DataFrame:
    """All headers in snake_case; repeats get _2, _3, …"""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        base = snake(c)
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def across(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one expression to several columns in a single projection."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Replace cells by the non-NULL cells of ``overrides`` (unique by ``key``)."""
    cols = [c for c in overrides.columns if c != key]
    patch = overrides.select(F.col(key).alias("__k"), *[F.col(c).alias("__o_" + c) for c in cols])
    joined = df.join(patch, F.col(key).eqNullSafe(F.col("__k")), "left")
    return joined.withColumns({c: F.coalesce(F.col("__o_" + c), F.col(c)) for c in cols}).drop(
        "__k", *["__o_" + c for c in cols]
    )


# ---- joins ---------------------------------------------------------------------------------------------


def left_on(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "left") -> DataFrame:
    """Join on differently named keys; NULL matches NULL and the left key names stay."""
    renamed = right.withColumnsRenamed({b: f"__r_{b}" for b in on.values()})
    clash = set(left.columns) & set(renamed.columns)
    if clash and how not in ("left_semi", "left_anti"):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    cond = reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(f"__r_{b}")) for a, b in on.items()])
    out = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how == "right":
        out = out.withColumns({a: F.col(f"__r_{b}") for a, b in on.items()})
    return out.drop(*[f"__r_{b}" for b in on.values()])


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on every column name the two tables share."""
    keys = [c for c in left.columns if c in set(right.columns)]
    if not keys:
        raise ValueError("no shared column names")
    log.info("joining by %s", ", ".join(keys))
    return left_on(left, right, {k: k for k in keys}, how)


def keep_in(left: DataFrame, right: DataFrame, key: str | Mapping[str, str]) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    on = {key: key} if isinstance(key, str) else dict(key)
    return left_on(left, right.select(*on.values()), on, "left_semi")


def join_suffix(
    left: DataFrame, right: DataFrame, on: Sequence[str], sx: str = "_x", sy: str = "_y", how: str = "left"
) -> DataFrame:
    """Join on equal names; other shared columns get a suffix on either side."""
    clash = (set(left.columns) & set(right.columns)) - set(on)
    lhs = left.withColumnsRenamed({c: c + sx for c in clash})
    rhs = right.withColumnsRenamed({c: c + sy for c in clash})
    return left_on(lhs, rhs, {k: k for k in on}, how)


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every column of a one-row table beside each row; any other number of rows is an error at run time."""
    once = one_row.agg(F.count(F.lit(1)).alias("__rows"), *[F.any_value(c).alias(c) for c in one_row.columns])
    checked = once.filter(F.assert_true(F.col("__rows") == 1, "attach_scalar needs exactly one row").isNull())
    return beside(df, checked.drop("__rows"))


def attach_labels(df: DataFrame, dim: DataFrame, key: str | Mapping[str, str]) -> DataFrame:
    """Left join of a label table that is unique by its key."""
    on = {key: key} if isinstance(key, str) else dict(key)
    return left_on(df, dim, on, "left")


# ---- appends, order ------------------------------------------------------------------------------------


def append(tables: Mapping[str, DataFrame] | Sequence[DataFrame], tag: str | None = None) -> DataFrame:
    """Append by name, missing columns NULL; a mapping also writes its key to column ``tag``."""
    if isinstance(tables, Mapping):
        parts = [d.withColumn(tag, F.lit(k)) if tag else d for k, d in tables.items()]
    else:
        parts = list(tables)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def append_text(tables: Sequence[DataFrame], types: Mapping[str, str]) -> DataFrame:
    """Append batches whose column types disagree: all as text, then the stated types where they parse."""
    text = [d.select(*[F.col(c).cast("string").alias(c) for c in d.columns]) for d in tables]
    out = append(text)
    return out.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def top_k(df: DataFrame, keys: Sequence[Column | str], k: int) -> DataFrame:
    """First k rows in the stated order; end ``keys`` with a unique column."""
    return df.orderBy(*[as_col(c) for c in keys]).limit(k)
