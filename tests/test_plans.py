"""Plans: no Python rows, no cartesian product, no one-partition window over rows, filters and columns pushed down."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bindings import ORACLES, QUERIES
from haulgrid.operators import spatial as P
from haulgrid.operators.reshape import pivot_values

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")

# plans of one query per operator family
SAMPLE = [
    "agg_group", "agg_mode", "agg_quantile", "agg_density", "win_impute_mean", "win_percent_rank", "win_row_batch", "win_share",
    "win_top1", "filter_quantile", "sjoin_contains", "sjoin_nearest", "sjoin_within_distance", "geo_clip_lines",
    "geo_split_lines", "job_lq_depth", "job_segment_delay", "job_rail_volume", "job_crossings",
]


def plan_of(spark, name):
    df = entry.queries()[name](spark, DATA)
    return df._jdf.queryExecution().toString()


def depth(line):
    return len(re.match(r"[ :|+\-*()\d]*", line)[0])


def built_side(lines, i):
    """The lines of the broadcast below a nested-loop join: the last child for BuildRight, else the first."""
    below = [k for k in range(i + 1, len(lines)) if all(depth(x) > depth(lines[i]) for x in lines[i + 1 : k + 1])]
    starts = [k for k in below if "BroadcastExchange" in lines[k] or "BroadcastQueryStage" in lines[k]]
    child = min(depth(lines[k]) for k in starts)
    own = [k for k in starts if depth(lines[k]) == child]
    start = own[-1] if "BuildRight" in lines[i] else own[0]
    return lines[start : start + 8]


@pytest.mark.parametrize("name", SAMPLE)
def test_plan_shape(spark, name):
    plan = plan_of(spark, name)
    physical = plan[plan.index("== Physical Plan ==") :]
    for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in physical
    # a nested-loop join may only meet one row: the result of an ungrouped aggregate
    lines = physical.splitlines()
    for i, line in enumerate(lines):
        if "BroadcastNestedLoopJoin" in line:
            built = built_side(lines, i)
            assert any("keys=[]" in part for part in built[:6]) or "__nx" in " ".join(built), "\n".join(lines[i : i + 12])


@pytest.mark.parametrize("name", ["win_percent_rank", "win_row_batch", "batch_payloads", "job_zone_batches"])
def test_single_partition_windows_only_see_bucket_totals(spark, name):
    plan = plan_of(spark, name)
    lines = plan[plan.index("== Physical Plan ==") :].splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line and "__bucket" in line and "partition" not in line:
            continue
        if "Exchange SinglePartition" in line:
            # what is gathered is either partial aggregates or one row per bucket
            below = " ".join(lines[i + 1 : i + 4])
            assert "Aggregate" in below or "__size" in below, "\n".join(lines[max(0, i - 3) : i + 4])


def test_filters_and_columns_reach_the_scan(spark):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = entry.queries()["filter_conj"](spark, DATA)._jdf.queryExecution().explainString(mode)
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThan(o_totalprice" in plan
    assert "o_orderdate" not in plan


def test_top_k_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "topk")
    assert "WindowGroupLimit" in plan_of(spark, "win_top1")


def test_every_query_is_listed_with_matching_twin():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert QUERIES.keys() == ORACLES.keys() and QUERIES.keys() <= entry.queries().keys()


def test_crowded_cell_is_split(spark):
    """A third of the points in one cell: adaptive execution splits that shuffle partition."""
    saved = {k: spark.conf.get(k) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "200KB")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100KB")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        k = F.col("id")
        pts = spark.range(0, 120000, 1, 8).select(
            "id", F.when(k % 3 == 0, 500.5).otherwise((k * 37 % 1000).cast("double")).alias("x"),
            F.when(k % 3 == 0, 500.5).otherwise((k * 91 % 1000).cast("double")).alias("y"), F.sha2(k.cast("string"), 256).alias("payload"),
        )
        segs = spark.range(1000).select(
            (k * 37 % 1000).cast("double").alias("x1"), (k * 91 % 1000).cast("double").alias("y1"),
            (k * 37 % 1000 + 3.0).alias("x2"), (k * 91 % 1000 + 2.0).alias("y2"),
        )
        df = P.within_distance(pts, segs, 2.0, cell=50.0).agg(F.count(F.lit(1)).alias("n"), F.max("payload"))
        n = df.collect()[0]["n"]
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100MB")
        assert P.within_distance(pts, segs, 2.0, cell=50.0).count() == n
    finally:
        for key, value in saved.items():
            spark.conf.set(key, value)


def test_pivot_makes_one_row_of_a_key_before_the_shuffle(spark):
    rows = [(k, v, float(i)) for k in ("a", None) for i, v in enumerate(("x", "y", "y", "other"))] + [("b", None, 9.0)]
    wide = pivot_values(spark.createDataFrame(rows, "k string, v string, n double"), ["k"], "v", ["x", "y"], "n")
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("partial_max") and plan.count("Exchange") == 1
    assert {tuple(r) for r in wide.collect()} == {("a", 0.0, 2.0), (None, 0.0, 2.0), ("b", None, None)}
