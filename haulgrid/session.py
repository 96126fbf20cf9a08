"""Session settings the library is designed for, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Adaptive execution sizes partitions, splits skewed join partitions (also when one key fills them) and
# switches to a broadcast join only after it has measured the side; forcing the split also covers joins
# that feed a grouping. The thresholds are low because a spatial join works hard on few bytes.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.session.timeZone": "UTC",
}

# These can only be given when a session is built. Collecting a stack trace for every column expression
# takes longer than planning the query.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


_written: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Set the recommended runtime settings; partition counts and memory stay as the cluster has them."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str | None:
    """Where intermediate tables go: the folder the cluster names, or a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="haulgrid-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return None


def new_path(spark: SparkSession, tag: str) -> str:
    """A path nothing has been written to yet, in the shared folder."""
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can write to")
    return f"{folder}/haulgrid-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "table", row_key: str | None = None) -> DataFrame:
    """Write a table that several later steps use and read it back.

    It is computed once, its lineage ends there, lost executors cannot undo it, and the planner knows its size.
    ``row_key`` adds a text column that differs for every written row, also for copies of one row, and stays
    the same in every later run over the table. Without a shared folder this raises, as what follows relies on it.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    if row_key is None:
        return table
    number = F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0")
    return table.select("*", F.concat(F.col("_metadata.file_name"), F.lit(":"), number).alias(row_key))


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables ``materialize`` has written, but for the first ``since`` ones, and return their number."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    count = len(_written) - since
    while len(_written) > since:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(hadoop).delete(path, True)
    return count


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``materialize`` writes inside; tables that were there before stay."""
    before = len(_written)
    try:
        yield
    finally:
        release(spark, before)
