"""Aggregations and pivots."""

from pyspark.sql import functions as F

from haulgrid.functions.nulls import ratio, row_sum
from haulgrid.functions.scalar import bucketize
from haulgrid.operators import aggregates as A
from haulgrid.operators import reshape as S

from .registry import query, table


@query("agg_group", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty,
       round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate) AS first_ship
FROM lineitem GROUP BY 1, 2
""")
def agg_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.min("l_shipdate").alias("first_ship"),
    )


@query("agg_sector_totals", """
SELECT l_suppkey, round(sum(l_tax + l_discount), 4) AS group_total,
       round(sum(l_tax + l_discount) / nullif(sum(l_quantity), 0), 6) AS group_share
FROM lineitem GROUP BY 1
""")
def agg_sector_totals(spark, d):
    return (
        table(spark, d, "lineitem").groupBy("l_suppkey")
        .agg(A.sum_cols(["l_tax", "l_discount"]).alias("t"), F.sum("l_quantity").alias("q"))
        .select("l_suppkey", F.round("t", 4).alias("group_total"), F.round(ratio("t", "q"), 6).alias("group_share"))
    )


@query("agg_count", """
SELECT o_orderpriority, n, o_orderpriority || ' (' || n || ')' AS label
FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, o_orderpriority
""")
def agg_count(spark, d):
    return A.count_by(table(spark, d, "orders"), "o_orderpriority").orderBy(F.desc("n"), "o_orderpriority")


@query("agg_global", """
SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
""")
def agg_global(spark, d):
    return table(spark, d, "orders").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("agg_two_level", """
SELECT p_type, count(*) AS brands, round(sum(q), 2) AS q, round(max(q), 2) AS top
FROM (SELECT p_type, p_brand, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
GROUP BY 1
""")
def agg_two_level(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    fine = (
        li.join(p, li.l_partkey == p.p_partkey).groupBy("p_type", "p_brand").agg(F.sum("l_quantity").alias("q"))
    )
    return fine.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("brands"), F.round(F.sum("q"), 2).alias("q"), F.round(F.max("q"), 2).alias("top")
    ).select("p_type", "brands", "q", "top")


@query("agg_subset_share", """
SELECT o_orderstatus, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS share
FROM orders GROUP BY 1
""")
def agg_subset_share(spark, d):
    out = A.share_of(table(spark, d, "orders"), F.col("o_orderpriority") == "1-URGENT", "o_totalprice", ["o_orderstatus"])
    return out.withColumn("share", F.round("share", 6))


@query("agg_total_row", """
SELECT CASE WHEN g = 1 THEN 'Total' ELSE label END AS label, n, round(total, 2) AS total FROM (
SELECT label, grouping(label) AS g, CAST(sum(n) AS BIGINT) AS n, sum(total) AS total FROM (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS label, count(*) AS n,
         sum(o_totalprice) AS total FROM orders GROUP BY 1) GROUP BY ROLLUP (label))
""")
def agg_total_row(spark, d):
    label = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    t = table(spark, d, "orders").groupBy(label.alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
    )
    return A.with_total_row(t, "label", ["n", "total"], "Total").withColumn("total", F.round("total", 2))


@query("agg_mode", """
WITH c AS (SELECT s, v, count(*) AS n FROM (
  SELECT l_suppkey AS s, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS v FROM lineitem)
  GROUP BY 1, 2)
SELECT s AS l_suppkey, v AS mode_qty FROM (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, v NULLS LAST) AS r FROM c) WHERE r = 1
""")
def agg_mode(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_suppkey", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity").cast("int")).alias("mode_qty")
    )
    return A.mode_by(li, ["l_suppkey"], ["mode_qty"])


@query("agg_quantile", """
SELECT round(quantile_cont(l_extendedprice, 0.9), 4) AS q FROM lineitem
""")
def agg_quantile(spark, d):
    return A.quantile(table(spark, d, "lineitem"), "l_extendedprice", 0.9).select(F.round("q", 4).alias("q"))


@query("agg_distinct_keys", "SELECT DISTINCT p_type, p_brand FROM part")
def agg_distinct_keys(spark, d):
    return table(spark, d, "part").select("p_type", "p_brand").distinct()


@query("agg_weighted_mean", """
SELECT k, round(w, 4) AS w, round(coalesce(ns, 0) / nullif(w, 0), 6) AS spd, round(nf / nullif(w, 0), 6) AS fff FROM (
SELECT l_partkey AS k, CASE WHEN count(l_extendedprice) = count(*) THEN sum(l_extendedprice) END AS w,
  sum(l_extendedprice * spd) AS ns, CASE WHEN count(fff) = count(*) THEN sum(l_extendedprice * fff) END AS nf
FROM (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS spd,
             CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE 1 - l_discount END AS fff FROM lineitem) GROUP BY 1)
""")
def agg_weighted_mean(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("k"),
        F.col("l_extendedprice").alias("w"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("spd"),
        F.when(F.col("l_orderkey") % 97 != 0, 1 - F.col("l_discount")).alias("fff"),
    )
    out = A.weighted_mean(li, ["k"], "w", skip=["spd"], strict=["fff"])
    return out.select("k", F.round("w", 4).alias("w"), F.round("spd", 6).alias("spd"), F.round("fff", 6).alias("fff"))


@query("agg_all_pass", """
SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity > 10)
""")
def agg_all_pass(spark, d):
    return A.all_pass(table(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity") > 10)


@query("agg_designated_row", """
SELECT o_orderstatus, round(max(CASE WHEN o_orderpriority = '1-URGENT' THEN t END), 2) AS urgent, round(sum(t), 2) AS total
FROM (SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2) GROUP BY 1
""")
def agg_designated_row(spark, d):
    t = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.sum("o_totalprice").alias("t"))
    return t.groupBy("o_orderstatus").agg(
        F.round(A.designated(F.col("o_orderpriority") == "1-URGENT", "t"), 2).alias("urgent"),
        F.round(F.sum("t"), 2).alias("total"),
    )


@query("agg_histogram", """
SELECT floor(l_extendedprice / 2000 + 0.5) * 2000.0 AS bin_center, count(*) AS n FROM lineitem GROUP BY 1
""")
def agg_histogram(spark, d):
    return A.histogram(table(spark, d, "lineitem"), "l_extendedprice", width=2000)


@query("agg_histogram_bins", """
SELECT round(floor(value / w + 0.5) * w, 6) AS bin_center, count(*) AS n
FROM events, (SELECT (max(value) - min(value)) / 29 AS w FROM events) GROUP BY 1
""")
def agg_histogram_bins(spark, d):
    return A.histogram(table(spark, d, "events"), "value", bins=30).withColumn("bin_center", F.round("bin_center", 6))


@query("agg_hist2d", """
SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin_x, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS bin_y, count(*) AS n
FROM lineitem GROUP BY 1, 2
""")
def agg_hist2d(spark, d):
    return A.hist2d(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 5, 5000)


@query("agg_density", """
WITH kept AS (SELECT event_type, value AS x FROM events WHERE value BETWEEN 0 AND 200),
bw AS (SELECT event_type, count(*) AS n,
  0.9 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * power(count(*), -0.2) AS h
  FROM kept GROUP BY 1),
pos AS (SELECT event_type, x / (200.0 / 256) AS p, least(floor(x / (200.0 / 256)), 255) AS l FROM kept),
nodes AS (SELECT event_type, i, sum(w) AS w FROM (
  SELECT event_type, l AS i, 1 - (p - l) AS w FROM pos UNION ALL SELECT event_type, l + 1, p - l FROM pos) GROUP BY 1, 2)
SELECT event_type, round(g.g * (200.0 / 63), 4) AS x,
  round(sum(w * exp(-0.5 * power((g.g * (200.0 / 63) - i * (200.0 / 256)) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 6) AS density
FROM nodes JOIN bw USING (event_type), range(64) g(g) GROUP BY event_type, g.g
""")
def agg_density(spark, d):
    out = A.density(table(spark, d, "events"), "value", "event_type", 0.0, 200.0, n=64, bins=256)
    return out.select("event_type", F.round("x", 4).alias("x"), F.round("density", 6).alias("density"))


@query("bucketize_breaks", """
SELECT event_id, CASE WHEN value < 0 THEN NULL WHEN value < 10 THEN 1 WHEN value < 50 THEN 2 WHEN value < 100 THEN 3
  WHEN value <= 300 THEN 4 END AS class FROM events
""")
def bucketize_breaks(spark, d):
    return table(spark, d, "events").select("event_id", bucketize("value", [0, 10, 50, 100, 300]).alias("class"))


# ---- pivots --------------------------------------------------------------------------------------------

STATUSES = ["F", "O", "P"]


@query("pivot_counts", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
       count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1
""")
def pivot_counts(spark, d):
    return S.pivot_counts(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", STATUSES)


@query("pivot_values", """
SELECT n_regionkey, max(CASE WHEN n_nationkey // 5 = 0 THEN n_name END) AS k0,
       max(CASE WHEN n_nationkey // 5 = 1 THEN n_name END) AS k1, max(CASE WHEN n_nationkey // 5 = 2 THEN n_name END) AS k2,
       max(CASE WHEN n_nationkey // 5 = 3 THEN n_name END) AS k3, max(CASE WHEN n_nationkey // 5 = 4 THEN n_name END) AS k4,
       max(CASE WHEN n_nationkey // 5 = 7 THEN n_name END) AS k7
FROM nation GROUP BY 1
""")
def pivot_values(spark, d):
    n = table(spark, d, "nation").select(
        "n_regionkey", "n_name", F.concat(F.lit("k"), F.floor(F.col("n_nationkey") / 5).cast("string")).alias("variable")
    )
    return S.pivot_values(n, ["n_regionkey"], "variable", ["k0", "k1", "k2", "k3", "k4", "k7"], "n_name")


@query("totals_one_row", """
SELECT round(sum(l_tax) / sum(l_quantity), 8) AS l_tax_share, round(sum(l_discount) / sum(l_quantity), 8) AS l_discount_share
FROM lineitem
""")
def totals_one_row(spark, d):
    t = S.totals_row(table(spark, d, "lineitem"), ["l_tax", "l_discount"], "l_quantity")
    return t.select(*[F.round(c, 8).alias(c) for c in t.columns])


@query("row_sum", """
SELECT l_orderkey, round(coalesce(disc, 0) + l_tax + l_quantity, 4) AS lenient, round(disc + l_tax + l_quantity, 4) AS strict
FROM (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS disc FROM lineitem)
""")
def row_sum_q(spark, d):
    disc = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount"))
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        F.round(row_sum(disc, "l_tax", "l_quantity", skip_null=True), 4).alias("lenient"),
        F.round(row_sum(disc, "l_tax", "l_quantity"), 4).alias("strict"),
    )
