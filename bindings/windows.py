"""Group means and shares beside rows, global ranks, row numbers, top rows per group."""

from pyspark.sql import functions as F

from haulgrid.functions.nulls import ratio
from haulgrid.operators import ranking as K
from haulgrid.operators.skew import attach_by_key

from .registry import query, table


@query("win_impute_mean", """
SELECT event_id, round(coalesce(v, avg(v) OVER (PARTITION BY event_type)), 4) AS v, v IS NULL AS missing
FROM (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
""")
def win_impute_mean(spark, d):
    e = table(spark, d, "events").select(
        "event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v")
    )
    return K.impute_group_mean(e, ["event_type"], "v").select("event_id", F.round("v", 4).alias("v"), "missing")


@query("win_percent_rank", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, round(CAST(rank() OVER (ORDER BY v) - 1 AS DOUBLE) / (SELECT count(v) - 1 FROM e), 8) AS percent_rank
FROM e WHERE v IS NOT NULL UNION ALL SELECT event_id, NULL FROM e WHERE v IS NULL
""")
def win_percent_rank(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return K.percent_rank_global(e, "v").select("event_id", F.round("percent_rank", 8).alias("percent_rank"))


@query("win_share", """
SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders
""")
def win_share(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return K.share_within(o, ["o_custkey"], "o_totalprice").select("o_orderkey", F.round("share", 8).alias("share"))


@query("win_share_total", """
WITH t AS (SELECT o_orderpriority AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT p, round(v / (SELECT sum(v) FROM t), 8) AS of_total,
       round(v / (SELECT max(v) FROM t WHERE p = '1-URGENT'), 8) AS of_urgent FROM t
""")
def win_share_total(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.sum("o_totalprice").alias("v"))
    t = K.share_of_total(t, "v", "of_total")
    t = K.share_of_total(t, "v", "of_urgent", where=F.col("p") == "1-URGENT")
    return t.select("p", F.round("of_total", 8).alias("of_total"), F.round("of_urgent", 8).alias("of_urgent"))


@query("win_row_batch", """
SELECT o_orderkey, row_num, CAST(ceil(row_num / 1000.0) AS INT) AS batch
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY -o_totalprice, o_orderkey) AS row_num FROM orders)
""")
def win_row_batch(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return K.row_id(o, [-F.col("o_totalprice"), "o_orderkey"]).select(
        "o_orderkey", "row_num", K.batch_id("row_num", 1000).alias("batch")
    )


@query("win_top1", """
SELECT p_type, p_brand, round(q, 2) AS q FROM (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY q DESC, p_brand) AS r FROM (
    SELECT p_type, p_brand, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))
WHERE r = 1
""")
def win_top1(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    q = li.join(p, li.l_partkey == p.p_partkey).groupBy("p_type", "p_brand").agg(F.sum("l_quantity").alias("q"))
    return K.top_per_group(q, ["p_type"], [F.desc("q"), F.col("p_brand")]).withColumn("q", F.round("q", 2))


@query("win_share_quotient", """
SELECT o_orderkey, round(o_totalprice / max(CASE WHEN o_orderkey = first_key THEN o_totalprice END) OVER (PARTITION BY o_custkey), 6) AS q
FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_key FROM orders)
""")
def win_share_quotient(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    base = o.groupBy("o_custkey").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("base"), F.count(F.lit(1)).alias("n")
    )
    return attach_by_key(o, base, ["o_custkey"], "n").select(
        "o_orderkey", F.round(ratio("o_totalprice", "base"), 6).alias("q")
    )
