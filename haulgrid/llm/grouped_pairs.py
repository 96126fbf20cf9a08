"""Pairs within groups of rows, dealt over many tasks also when one group is large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one group that meet each other in one task; larger groups are cut into blocks that meet pairwise.
BLOCK = 4096


def meet(left: DataFrame, right: DataFrame, keys: list[str], within: Column, member: str, block: int = BLOCK) -> DataFrame:
    """Rows of ``left`` beside rows of ``right`` with equal ``keys``, columns prefixed a_ and b_, where ``within`` holds.

    Both have ``held``, the size of their group, and ``member``, which tells a group's rows apart. A group of more than
    ``block`` rows is dealt into blocks by the hash of ``member``; every block of one side meets every block of the other
    under a key of its own, so no task holds a whole large group. Keys must not be NULL.
    """
    def prefixed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select([F.col(c).alias(prefix + c) for c in df.columns])

    def equal(names: list[str]) -> Column:
        same = within
        for k in names:
            same = (F.col("a_" + k) == F.col("b_" + k)) & same
        return same

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        blocks = F.ceil(F.col("held") / block).cast("int")
        return df.filter(F.col("held") > block).withColumn(own, F.pmod(F.xxhash64(member), blocks).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), blocks - 1))
        )

    small = F.col("held") <= block
    plain = prefixed(left.filter(small), "a_").join(prefixed(right.filter(small), "b_"), equal(keys))
    blocks = prefixed(dealt(left, "__x", "__y"), "a_").join(
        prefixed(dealt(right, "__y", "__x"), "b_"), equal([*keys, "__x", "__y"])
    )
    return plain.unionByName(blocks.select(plain.columns))
