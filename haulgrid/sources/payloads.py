"""Batched request bodies for a zone service that takes a limited number of rows per request."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import batch_id, row_id
from ..operators.skew import beside


def number_batches(df: DataFrame, size: int, order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds ``row_num``, ``batch`` and ``batch_name`` ('name_i_of_n')."""
    numbered = row_id(df, order).withColumn("batch", batch_id("row_num", size))
    batches = df.agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("__n"))
    label = F.concat(F.lit(name + "_"), F.col("batch").cast("string"), F.lit("_of_"), F.col("__n").cast("string"))
    return beside(numbered, batches).withColumn("batch_name", label).drop("__n")


def payloads(numbered: DataFrame, item: Column, header: Mapping[str, object]) -> DataFrame:
    """One JSON body per batch of an already numbered table; a batch never holds more than its size."""
    rows = numbered.groupBy("batch", "batch_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sort_array(F.collect_list(F.struct(F.col("row_num"), item.alias("item")))).alias("rows"),
    )
    body = F.to_json(
        F.struct(
            *[F.lit(v).alias(k) for k, v in header.items()],
            F.col("batch_name").alias("zone_set_name"),
            F.transform("rows", lambda r: r["item"]).alias("zones"),
        ),
        {"ignoreNullFields": "false"},
    )
    return rows.select("batch", "batch_name", "n_rows", body.alias("body"))


def batch_payloads(
    df: DataFrame,
    size: int,
    name: str,
    order: Sequence[Column | str],
    columns: Sequence[str],
    header: Mapping[str, object] | None = None,
) -> DataFrame:
    """Rows in the stated order, ``size`` per batch, one JSON document per batch."""
    item = F.struct("row_num", *columns)
    return payloads(number_batches(df, size, order, name), item, header or {"geom_type": "line"})


def request_configs(batches: DataFrame, config: Mapping[str, Column | str], suffix: str) -> DataFrame:
    """One analysis request per batch name, the shared options taken from ``config``."""
    options = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in config.items()]
    body = F.to_json(
        F.struct(
            F.concat(F.col("batch_name"), F.lit(suffix)).alias("analysis_name"),
            *options,
            F.array(F.struct(F.col("batch_name").alias("name"))).alias("oz_sets"),
        )
    )
    return batches.select("batch_name").distinct().select("batch_name", body.alias("config"))
