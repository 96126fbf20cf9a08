"""Missing-value rules on literal tables."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from haulgrid.functions import nulls as N
from haulgrid.functions import scalar as X
from haulgrid.operators import aggregates as A
from haulgrid.operators import ranking as K
from haulgrid.operators import relational as R


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_strict_sum_turns_null_with_one_missing_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, v double")
    out = df.groupBy("g").agg(N.strict_sum("v").alias("s"), N.lenient_sum("v").alias("l"))
    assert rows(out) == [("a", None, 1.0), ("b", 2.0, 2.0)]
    assert df.filter("v > 9").agg(N.strict_sum("v").alias("s")).first()["s"] == 0


def test_in_set_is_never_null(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    assert rows(df.filter(~N.in_set("c", "x"))) == [(None,), ("y",)]
    assert df.filter(N.in_set("c")).count() == 0


def test_ratio_and_number_do_not_raise(spark):
    df = spark.createDataFrame([("1", 0.0), ("(D)", 2.0)], "t string, d double")
    out = df.select(N.ratio(F.lit(1), "d").alias("r"), N.number("t").alias("n"))
    assert rows(out) == [(None, 1.0), (0.5, None)]


def test_coalesce_max_and_row_sum(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, 2)], "a int, b int")
    out = df.select(
        N.coalesce_max("a", "b").alias("m"), N.row_sum("a", "b").alias("s"), N.row_sum("a", "b", skip_null=True).alias("l")
    )
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, None, 1), (None, None, 0), (3, 5, 5)], key=str)


def test_joins_match_null_keys_and_keep_left_names(spark):
    left = spark.createDataFrame([(1, None), (2, "a"), (3, "z")], "id int, k string")
    right = spark.createDataFrame([(None, "none"), ("a", "A")], "key string, label string")
    assert rows(R.left_on(left, right, {"k": "key"}), "id") == [(1, None, "none"), (2, "a", "A"), (3, "z", None)]
    with pytest.raises(ValueError):
        R.left_on(left, right.withColumnRenamed("label", "id"), {"k": "key"})


def test_natural_join_uses_all_shared_names(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "p int, q int, v string")
    b = spark.createDataFrame([(1, 2, "w")], "p int, q int, t string")
    assert rows(R.natural_join(a, b), "q") == [(1, 1, "x", None), (1, 2, "y", "w")]
    with pytest.raises(ValueError):
        R.natural_join(a, b.select(F.col("t").alias("other")))


def test_right_join_keeps_areas_without_measures(spark):
    a = spark.createDataFrame([("z1", 5)], "zip string, trucks int")
    z = spark.createDataFrame([("z1",), ("z2",)], "zip string")
    assert rows(R.natural_join(a, z, "right").select("zip", "trucks")) == [("z1", 5), ("z2", None)]


def test_semi_join_does_not_multiply(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (1,)], "k int")
    assert rows(R.keep_in(a, b, "k")) == [(1,)]


def test_percent_rank_leaves_missing_values_out(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0), (4, 5.0)], "id int, v double")
    assert rows(K.percent_rank_global(df, "v").select("id", "percent_rank")) == [(1, 0.0), (2, None), (3, 1.0), (4, 0.0)]


def test_mode_counts_missing_values_and_prefers_the_smallest(spark):
    df = spark.createDataFrame(
        [("a", None), ("a", None), ("a", 1), ("b", 3), ("b", 2), ("c", None), ("c", 4)], "g string, v int"
    )
    assert rows(A.mode_by(df, ["g"], ["v"])) == [("a", None), ("b", 2), ("c", 4)]


def test_quantile_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    assert A.quantile(df, "v", 0.9).first()["q"] == pytest.approx(7.9)


def test_two_digit_years(spark):
    df = spark.createDataFrame([("95",), ("16",), ("x",)], "y string")
    assert [r[0] for r in df.select(X.year_from_yy("y", 23)).collect()] == [1995, 2016, None]


def test_classify_skips_null_conditions(spark):
    df = spark.createDataFrame([(None,), (1,), (0,)], "a int")
    out = df.select(X.classify([(F.col("a") > 0, "pos")], "other").alias("c"), X.classify([(F.col("a") > 0, "pos")]).alias("d"))
    assert [tuple(r) for r in out.collect()] == [("other", None), ("pos", "pos"), ("other", None)]


def test_bucketize_edges(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (10.0,), (11.0,), (None,)], "v double")
    assert [r[0] for r in df.select(X.bucketize("v", [0, 5, 10])).collect()] == [None, 1, 2, 2, None, None]


def test_labels_and_suffixes(spark):
    df = spark.createDataFrame([(0.1234, "FarmingT", "abc")], "p double, t string, u string")
    row = df.select(
        X.percent_label("p").alias("p"), X.strip_suffix("t", "T").alias("t"), X.strip_suffix("u", "T").alias("u"),
        X.suffix("u", 2).alias("s"), X.wrap_degrees(F.lit(-0.5)).alias("w"), X.wrap_degrees(F.lit(-90.7)).alias("n"),
    ).first()
    assert tuple(row) == ("12.3%", "Farming", "abc", "bc", 360, 270)


def test_clean_names_deduplicates(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Zone ID` int, `zone id` int, `Avg. Speed (%)` int")
    assert R.clean_names(df).columns == ["zone_id", "zone_id_2", "avg_speed_percent"]


def test_append_text_retypes_what_parses(spark):
    a = spark.createDataFrame([(1, "x")], "n int, t string")
    b = spark.createDataFrame([("oops", 2.5)], "n string, extra double")
    out = R.append_text([a, b], {"n": "int"})
    assert out.columns == ["n", "t", "extra"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "x", None), (None, None, "2.5")], key=str)


def test_attach_scalar_needs_one_row(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    assert rows(R.attach_scalar(df, df.agg(F.sum("a").alias("t")))) == [(1, 3), (2, 3)]
    with pytest.raises(Exception, match="exactly one row"):
        R.attach_scalar(df, df.withColumnRenamed("a", "b")).collect()


def test_overrides_replace_only_given_cells(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "k string, x int, y int")
    patch = spark.createDataFrame([("a", 9, None)], "k string, x int, y int")
    assert rows(R.apply_overrides(df, patch, "k")) == [("a", 9, 2), ("b", 3, 4)]


def test_total_row_is_a_plain_sum(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 5)], "k string, x int, y int")
    assert rows(A.with_total_row(df, "k", ["x", "y"], "Total")) == [("Total", 3, 5), ("a", 1, None), ("b", 2, 5)]


def test_unknown_column_is_an_error(spark):
    with pytest.raises((AnalysisException, ValueError)):
        R.keep_in(spark.range(3), spark.range(2), {"id": "nope"}).collect()


def test_histogram_of_one_value_and_of_one_bin(spark):
    df = spark.createDataFrame([(4.0,), (4.0,), (None,)], "v double")
    assert [tuple(r) for r in A.histogram(df, "v", bins=5).collect()] == [(4.0, 2)]
    assert [tuple(r) for r in A.histogram(df, "v", bins=1).collect()] == [(4.0, 2)]
    wide = spark.createDataFrame([(0.0,), (10.0,)], "v double")
    assert [tuple(r) for r in A.histogram(wide, "v", bins=1).collect()] == [(5.0, 2)]
    assert sorted(tuple(r) for r in A.histogram(wide, "v", bins=3).collect()) == [(0.0, 1), (10.0, 1)]
