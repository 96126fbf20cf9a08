"""Delimited scans, layered scans, CSV output and named Parquet tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    fmt: str = "csv",
    partitions: int | None = None,
    infer: bool = False,
) -> DataFrame:
    """Scan with a stated schema, so codes keep their leading zeros; without one all CSV columns are text.

    ``infer`` reads a CSV once more to find its types. A gzip file is read by one task: give ``partitions`` to
    spread its rows.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", infer and schema is None)
    df = reader.format(fmt).load(path)
    return df.repartition(partitions) if partitions else df


def _headers(spark: SparkSession, pattern: str) -> dict[str, str]:
    """The first line of every file matching a glob, by path, in one job."""
    try:
        text = spark.read.text(pattern)
    except AnalysisException as e:
        raise FileNotFoundError(pattern) from e
    lines = text.select("value", F.col("_metadata.file_path").alias("path"), "_metadata.file_block_start")
    first = lines.filter("file_block_start = 0").groupBy("path").agg(F.first("value").alias("header"))
    return {r["path"]: r["header"] for r in first.collect()}


def read_glob_text(spark: SparkSession, pattern: str) -> DataFrame:
    """All files matching a glob appended as text columns; files may differ in columns and column order.

    Files with the same header are one scan, so the plan grows with the number of headers, not of files.
    """
    groups: dict[str, list[str]] = {}
    for path, header in sorted(_headers(spark, pattern).items()):
        groups.setdefault(header, []).append(path)
    out = None
    for paths in groups.values():
        names = spark.read.option("header", True).csv(paths[0]).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        part = spark.read.schema(schema).option("header", True).csv(paths)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_layers(
    spark: SparkSession, pattern: str, schema: T.StructType | str | None = None, fmt: str = "parquet", by: str = "file"
) -> DataFrame:
    """Many layers in one scan, each row tagged with its ``layer``.

    A layer is a file (tagged by its name without extension) or, with ``by="folder"``, a folder of part files.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.format(fmt).load(pattern)
    if by == "folder":
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    else:
        name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return df.select("*", name.alias("layer"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def save_tables(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One Parquet folder per name."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
