"""Connected components by rounds of large and small stars, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_SHARE
from .tables import drop_table, write_table

#: Edges that a node has at least if it is treated as hot.
HOT_LEAST = 64


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node around it.

    Nodes with at least ``HOT_SHARE`` of all edges number at most 2 / ``HOT_SHARE``, so what is around them is broadcast
    and their edges stay where they are.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    limit = max(edges.count() * HOT_SHARE, HOT_LEAST)
    hot, larger = F.broadcast(least.filter(F.col("n") >= limit).drop("n")), both.filter("v > u")
    tied = larger.join(hot, "u").unionByName(
        larger.join(hot, "u", "left_anti").join(least.filter(F.col("n") < limit).drop("n"), "u")
    )
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie every smaller neighbour of a node, and the node, to the smallest of them."""
    least = _smallest(edges)
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Every node has one edge to a smaller node, and none to a node that has one itself."""
    up = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    roots = edges.select(F.col("v").alias("root")).distinct()
    return up.join(roots, F.col("u") == F.col("root"), "left").filter("n > 1 or root is not null").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v) but the smallest of each component, which names it; written.

    Both columns have one orderable type. NULL ends, loops and repeated edges do no harm. A node with a third of
    all edges is one sum per task in the groupings and a splittable side in the joins. No edges: no rows.
    """
    ends = edges.filter("u is not null and v is not null and u <> v")
    now = write_table(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, now = now, write_table(_small_star(_large_star(now)).distinct(), "edges")
        drop_table(before)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
