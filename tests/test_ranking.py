"""Global ranks and numbers against the plain window, on skewed data and with every size check exceeded."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from haulgrid.operators import aggregates as A
from haulgrid.operators import ranking as K
from haulgrid.operators import skew
from haulgrid.session import materialize


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key and one value; some are missing."""
    df = spark.range(6000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 997).cast("int").alias("g"),
        F.when(F.col("id") % 3 == 0, 42.0).when(F.col("id") % 11 != 0, (F.col("id") * 7919) % 2003 / 8.0).alias("v"),
    )
    return df.cache()


def plain_percent_rank(df):
    known = df.filter("v IS NOT NULL")
    return {r["id"]: r["p"] for r in known.withColumn("p", F.percent_rank().over(Window.orderBy("v"))).collect()}


def test_percent_rank_matches_plain_window(spark, skewed):
    got = {r["id"]: r["percent_rank"] for r in K.percent_rank_global(skewed, "v").collect()}
    want = plain_percent_rank(skewed)
    assert len(got) == 6000
    assert all(got[i] == pytest.approx(want[i]) if i in want else got[i] is None for i in got)


@pytest.mark.parametrize("few", [10, 100_000])
def test_quantiles(spark, skewed, monkeypatch, few):
    monkeypatch.setattr(A, "BRACKET_VALUES", few)
    monkeypatch.setattr(A, "BRACKET_SAMPLE", 200)
    pdf = skewed.toPandas()
    for p in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert A.quantile(skewed, "v", p).first()["q"] == pytest.approx(pdf["v"].quantile(p))
    got = {r["g"]: r["m"] for r in A.quantiles_by(K.value_counts(skewed, "v", ["g"]), ["g"], "v", {"m": 0.3}).collect()}
    want = pdf.dropna(subset=["v"]).groupby("g")["v"].quantile(0.3)
    assert got == pytest.approx(want.to_dict())
    assert A.quantile(skewed.filter("v is null"), "v", 0.5).first()["q"] is None


def test_row_id_is_dense_and_ordered(spark, skewed):
    out = K.row_id(skewed, [-F.col("g"), "id"]).select("g", "id", "row_num").toPandas().sort_values("row_num")
    assert out["row_num"].tolist() == list(range(1, 6001))
    assert out[["g", "id"]].values.tolist() == sorted(out[["g", "id"]].values.tolist(), key=lambda r: (-r[0], r[1]))


def test_group_statistics_reach_every_row(spark, skewed):
    pdf = skewed.toPandas()
    pdf["w"] = pdf["v"].fillna(pdf.groupby("g")["v"].transform("mean"))
    got = K.impute_group_mean(skewed, ["g"], "v").toPandas().set_index("id")
    assert len(got) == 6000
    assert got["v"].to_dict() == pytest.approx(pdf.set_index("id")["w"].to_dict(), nan_ok=True)
    assert got["missing"].sum() == pdf["v"].isna().sum()


def test_copies_get_their_own_numbers_and_spread_over_buckets(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("name"))
    stored = materialize(df.repartition(4), "copies", "row")
    assert stored.select("row").distinct().count() == 3000
    out = K.row_id(stored, ["name", "row"]).toPandas().sort_values("row_num")
    assert out["row_num"].tolist() == list(range(1, 3001))
    assert out["name"].tolist() == sorted(out["name"])
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    placed = K._in_order(stored, ["name", "row"])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert placed.filter("name = 'same'").groupBy("__bucket").count().count() >= 4


@pytest.mark.parametrize("run", [
    lambda df: K.row_id(df, ["id"]), lambda df: K.percent_rank_global(df, "v"), lambda df: A.quantile(df, "v", 0.4),
    lambda df: A.quantiles_by(K.value_counts(df, "v", ["g"]), ["g"], "v", {"m": 0.3}),
])
def test_plans_do_not_grow_with_the_partitions(spark, skewed, run):
    """No split point is a literal: the plan for 8 partitions is as long as that for 200."""
    sizes = []
    for n in ("8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            plan = run(skewed.filter("id < 600"))._jdf.queryExecution().optimizedPlan().toString()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        sizes.append(len(re.sub(r"[0-9a-f]{32}|#\d+|\d+", "", plan)))
    assert abs(sizes[0] - sizes[1]) <= 0.05 * sizes[0]


def test_quantile_merges_no_sketches(spark, skewed, monkeypatch):
    monkeypatch.setattr(A, "BRACKET_VALUES", 10)
    monkeypatch.setattr(A, "BRACKET_SAMPLE", 100)
    monkeypatch.setattr(F, "percentile_approx", None)
    values = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 7919 / 7).alias("v"))
    pdf = values.toPandas()
    for p in (0.0, 1e-4, 0.05, 0.2, 0.37, 0.5, 0.77, 0.9999, 1.0):
        assert A.quantile(values, "v", p).first()["q"] == pytest.approx(pdf["v"].quantile(p))
    assert A.quantile(values.select(F.lit(3.0).alias("v")), "v", 0.3).first()["q"] == 3.0


def test_null_keys_get_their_group(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None), (3, "a", 5.0)], "id int, g string, v double")
    got = {r["id"]: r["v"] for r in K.impute_group_mean(df, ["g"], "v").collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 5.0}


@pytest.fixture
def plain(spark):
    """No adaptive execution and no broadcast but the hinted ones."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_partition_holds_a_hot_or_null_key(spark, plain):
    df = spark.range(20000, numPartitions=16).select(
        "id", F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 5 == 0, 7).otherwise(F.col("id")).cast("int").alias("g"),
    )
    stats = df.groupBy("g").agg(F.max("id").alias("m"), F.count(F.lit(1)).alias("n"))
    out = skew.attach_by_key(df, stats, ["g"], "n", hot_share=0.01)
    assert "SortMergeJoin" in out._jdf.queryExecution().toString()
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 20000 and max(sizes) <= 2 * 20000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = {r["g"]: r["m"] for r in stats.collect()}
    assert all(r["m"] == best[r["g"]] for r in out.collect())


def test_percent_rank_spreads_nulls_and_copies(spark, plain):
    df = spark.range(20000, numPartitions=16).select(
        "id", F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 3 == 0, 5.5).otherwise(F.col("id") % 4001).cast("double").alias("v")
    )
    out = K.percent_rank_global(df, "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan
    got = {r["id"]: r["percent_rank"] for r in out.collect()}
    want = plain_percent_rank(df)
    assert all(got[i] == pytest.approx(want[i]) if i in want else got[i] is None for i in got)


@pytest.mark.parametrize("n,batches", [(999, 1), (1000, 1), (1001, 2), (2000, 2)])
def test_exact_multiples_open_no_empty_batch(spark, n, batches):
    out = K.row_id(spark.range(n), ["id"]).select(K.batch_id("row_num", 1000).alias("b"))
    assert out.agg(F.max("b")).first()[0] == batches


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=40))
def test_percent_rank_is_a_share(spark, values):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id int, v double")
    known = [v for v in values if v is not None]
    for r in K.percent_rank_global(df, "v").collect():
        if r["v"] is None or len(known) == 1:
            assert r["percent_rank"] is None
        else:
            assert r["percent_rank"] == pytest.approx(sum(k < r["v"] for k in known) / (len(known) - 1))


def test_shares_and_top_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", None), ("c", 1.0)], "g string, v double")
    got = sorted(map(tuple, K.share_within(df, ["g"], "v").collect()), key=str)
    assert got == sorted([("a", 1.0, 0.25), ("a", 3.0, 0.75), ("b", 2.0, 1.0), ("c", None, None), ("c", 1.0, None)], key=str)
    top = K.top_per_group(df, ["g"], [F.desc_nulls_last("v")])
    assert sorted(map(tuple, top.collect())) == [("a", 3.0), ("b", 2.0), ("c", 1.0)]
