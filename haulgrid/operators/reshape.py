"""Long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import ratio


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """One row per value column; NULL values stay. Name only the columns that are wanted."""
    return df.unpivot(list(ids), list(values), name, value)


def pivot_counts(df: DataFrame, keys: Sequence[str], names: str, values: Sequence[str]) -> DataFrame:
    """Row counts per key and category, one column per listed category, 0 where there are none."""
    aggs = [F.count(F.when(F.col(names) == v, F.lit(1))).alias(v) for v in values]
    return df.groupBy(*keys).agg(*aggs)


def pivot_values(
    df: DataFrame, keys: Sequence[str], names: str, values: Sequence[str], measure: str
) -> DataFrame:
    """One column per listed variable; a (key, variable) pair holds one value.

    One grouping, so the rows of a key are one before they are shuffled wherever they lie together: what a task
    holds is as wide rows as there are keys in its input, not as many rows as there are pairs.
    """
    listed = [F.max(F.when(F.col(names) == v, F.col(measure))).alias(v) for v in values]
    return df.groupBy(*keys).agg(*listed).select(*keys, *values)


def pivot_sums(
    df: DataFrame, keys: Sequence[str], names: str, values: Sequence[str], measure: Column
) -> DataFrame:
    aggs = [F.coalesce(F.sum(F.when(F.col(names) == v, measure)), F.lit(0)).alias(v) for v in values]
    return df.groupBy(*keys).agg(*aggs)


def totals_row(df: DataFrame, cols: Sequence[str], total: str, suffix: str = "_share") -> DataFrame:
    """One row: each column's total over the total of ``total``."""
    return df.agg(*[ratio(F.sum(c), F.sum(total)).alias(c + suffix) for c in cols])
