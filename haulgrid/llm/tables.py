"""What the operators share: intermediate tables, row keys and the word rule."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words are runs of anything but space and the five ASCII control characters that separate.
WORD = r"[^\x20\x09-\x0D]+"


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there and lost executors cannot undo it."""
    path, conf = session.new_path(df.sparkSession, tag), df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")  # nothing reads this job's shuffles again
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)
    session._written.append(path)  # so that released() deletes it too
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete a table of ``write_table`` that nothing reads any more."""
    spark: SparkSession = table.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """A text column that differs for every row, also for copies of one, and stays the same when a task runs again.

    A table read from files takes it from the file and the row's place there; any other is written first.
    """
    key = F.concat(
        F.col("_metadata.file_path"), F.lit(":"), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0")
    )
    try:
        return df.select("*", key.alias(name))
    except AnalysisException:
        return write_table(df, "rows").select("*", key.alias(name))


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, mod ``modulus``: the rule that sets rows aside for tests."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def chosen_by_hash(key: Column, wanted: int, total: int) -> Column:
    """True for about ``wanted`` of ``total`` different keys, the same in every run; for all if there are fewer.

    Unlike the first rows in the order of a hash, which every task would send to one place, this is a filter.
    """
    return F.pmod(key, F.lit(1 << 40)) < F.lit(min(1.0, wanted / max(total, 1)) * float(1 << 40))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver's process was started; once for a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_haulgrid_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = f"{tempfile.mkdtemp(prefix='haulgrid-code-')}/haulgrid_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(target)
    context._haulgrid_shipped = True


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)
