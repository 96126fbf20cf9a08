"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

HOT_SHARE = 1e-3


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of an ungrouped aggregate, which is always one row, next to every row."""
    return df.join(F.broadcast(one_row), F.lit(True))


def _on(keys: Sequence[str], right_prefix: str):
    cond = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(right_prefix + k))
        cond = term if cond is None else cond & term
    return cond


def attach_by_key(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], count_col: str, hot_share: float = HOT_SHARE
) -> DataFrame:
    """Left-join per-key statistics (unique by ``keys``, with a row count) to every row of ``df``.

    The statistics are written once. Keys with at least ``hot_share`` of the rows number at most ``1 / hot_share``
    whatever the size, so they are broadcast. All other keys are joined as the planner sees fit by their measured
    bytes; if that shuffles, rows of hot keys are dealt by the task they come from instead of by their key. NULL is a
    key like any other.
    """
    keys = list(keys)
    values = [c for c in stats.columns if c not in keys and c != count_col]
    kept = materialize(
        stats.select(*[F.col(k).alias("__s_" + k) for k in keys], F.struct(F.lit(1), *values).alias("__v"),
                     F.col(count_col).alias("__rows")),
        "key-stats",
    )
    limit = (kept.agg(F.sum("__rows")).first()[0] or 0) * hot_share
    hot = kept.filter(F.col("__rows") >= limit).select(
        *[F.col("__s_" + k).alias("__h_" + k) for k in keys], F.col("__v").alias("__hot")
    )
    # not a literal, else the planner would take it out of the join key
    cold = kept.filter(F.col("__rows") < limit).withColumn("__s_deal", F.when(F.col("__rows") < 0, 0).otherwise(-1))
    dealt = df.join(F.broadcast(hot), _on(keys, "__h_"), "left").withColumn(
        "__deal", F.when(F.col("__hot").isNull(), -1).otherwise(F.spark_partition_id())
    )
    out = dealt.join(cold, _on(keys, "__s_") & (F.col("__deal") == F.col("__s_deal")), "left").withColumn(
        "__v", F.coalesce("__hot", "__v")
    )
    return out.select(*[F.col(c) for c in df.columns], *[F.col("__v")[v].alias(v) for v in values])
