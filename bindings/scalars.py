"""Scalar expressions over whole tables."""

from pyspark.sql import functions as F

from haulgrid.functions import nulls as N
from haulgrid.functions import scalar as X

from .registry import query, table


@query("str_prefix", "SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS p FROM orders")
def str_prefix(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.prefix("o_orderpriority", 1).alias("p"))


@query("str_suffix_strip", """
SELECT p_partkey, right(p_brand, 2) AS tail, CASE WHEN p_type LIKE '%E' THEN left(p_type, length(p_type) - 1) ELSE p_type END AS stripped
FROM part
""")
def str_suffix_strip(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", X.suffix("p_brand", 2).alias("tail"), X.strip_suffix("p_type", "E").alias("stripped")
    )


@query("str_len_concat", """
SELECT p_partkey, length(p_name) AS len, p_brand || ': ' || coalesce(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END, 'NA') AS label
FROM part
""")
def str_len_concat(spark, d):
    name = F.when(F.col("p_partkey") % 7 != 0, F.col("p_name"))
    return table(spark, d, "part").select(
        "p_partkey",
        F.char_length("p_name").cast("long").alias("len"),
        F.concat("p_brand", F.lit(": "), F.coalesce(name, F.lit("NA"))).alias("label"),
    )


@query("fmt_percent", """
SELECT l_orderkey, CAST(CAST(round(l_quantity / 37 * 100, 1) AS DECIMAL(18,1)) AS VARCHAR) || '%' AS label FROM lineitem
""")
def fmt_percent(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", X.percent_label(F.col("l_quantity") / 37).alias("label"))


@query("str_interaction", """
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'true' ELSE 'false' END || '.' || o_orderstatus AS cat FROM orders
""")
def str_interaction(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", X.interaction(F.col("o_totalprice") > 200000, "o_orderstatus").alias("cat")
    )


@query("math_round_ceil", """
SELECT o_orderkey, round(o_totalprice / 1000, 0) AS k, CAST(ceil(o_totalprice / 1320) AS BIGINT) AS n_parts,
       CAST(o_orderkey // 1000 AS BIGINT) AS whole, abs(o_totalprice - 250000) AS dist, -o_totalprice AS mirrored
FROM orders
""")
def math_round_ceil(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.round(price / 1000, 0).alias("k"),
        F.ceil(price / 1320).alias("n_parts"),
        F.floor(F.col("o_orderkey") / 1000).alias("whole"),
        F.abs(price - 250000).alias("dist"),
        (-price).alias("mirrored"),
    )


@query("math_greatest", """
SELECT l_orderkey, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a > b THEN a ELSE b END AS m
FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS a,
             CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice / 1000 END AS b FROM lineitem)
""")
def math_greatest(spark, d):
    a = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity"))
    b = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice") / 1000)
    return table(spark, d, "lineitem").select("l_orderkey", N.coalesce_max(a, b).alias("m"))


@query("math_change", """
SELECT c_custkey, round(c_acctbal - 1000, 4) AS change, round((c_acctbal - b) / nullif(b, 0), 6) AS pct
FROM (SELECT *, CAST(c_custkey % 5 AS DOUBLE) AS b FROM customer)
""")
def math_change(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey",
        F.round(X.change("c_acctbal", F.lit(1000)), 4).alias("change"),
        F.round(X.pct_change("c_acctbal", (F.col("c_custkey") % 5).cast("double")), 6).alias("pct"),
    )


@query("date_two_digit_year", """
SELECT o_orderkey, y FROM (SELECT o_orderkey, CASE WHEN yy IS NULL THEN NULL WHEN yy <= 23 THEN yy + 2000 ELSE yy + 1900 END AS y
  FROM (SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 11 = 0 THEN 'xx' ELSE right(CAST(year(o_orderdate) AS VARCHAR), 2) END AS INT) AS yy
  FROM orders)) WHERE y BETWEEN 1996 AND 2000
""")
def date_two_digit_year(spark, d):
    yy = F.when(F.col("o_orderkey") % 11 == 0, "xx").otherwise(X.suffix(F.year("o_orderdate").cast("string"), 2))
    return (
        table(spark, d, "orders").select("o_orderkey", X.year_from_yy(yy, 23).alias("y"))
        .filter(F.col("y").between(1996, 2000))
    )


@query("units_density", """
SELECT p_partkey, round(p_retailprice * 1000000 / (5280.0 * 5280.0), 6) AS sqmi, round(p_size / 5280.0, 8) AS miles,
       round(p_size / 1609.34, 8) AS miles_from_m,
       round(p_size / nullif(p_retailprice * 1000000 / (5280.0 * 5280.0), 0), 6) AS density
FROM part
""")
def units_density(spark, d):
    sqmi = X.to_sqmi(F.col("p_retailprice") * 1000000)
    return table(spark, d, "part").select(
        "p_partkey",
        F.round(sqmi, 6).alias("sqmi"),
        F.round(X.to_miles("p_size"), 8).alias("miles"),
        F.round(X.metres_to_miles("p_size"), 8).alias("miles_from_m"),
        F.round(N.ratio("p_size", sqmi), 6).alias("density"),
    )


@query("bearing_wrap", """
SELECT event_id, CASE WHEN b <= 0 THEN b + 360 ELSE b END AS bearing
FROM (SELECT event_id, CAST(trunc(value % 360 - 180) AS INT) AS b FROM events)
""")
def bearing_wrap(spark, d):
    return table(spark, d, "events").select("event_id", X.wrap_degrees(F.col("value") % 360 - 180).alias("bearing"))


@query("json_roundtrip", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS type FROM events
""")
def json_roundtrip(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.from_json("props", "k bigint").alias("p"), "event_type"
    )
    doc = F.to_json(F.struct("p.k", F.struct(F.col("event_type").alias("type")).alias("meta")))
    back = F.from_json("doc", "k bigint, meta struct<type:string>")
    return e.select("event_id", doc.alias("doc")).select("event_id", back.alias("b")).select(
        "event_id", "b.k", "b.meta.type"
    )
