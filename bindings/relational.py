"""Filters, projections, joins, sorts and appends."""

from pyspark.sql import functions as F

from haulgrid.functions.nulls import in_set, ratio, strict_sum
from haulgrid.functions.scalar import classify, flag_in, normalize_codes
from haulgrid.operators import relational as R
from haulgrid.operators.ranking import order_rank
from haulgrid.operators.reshape import unpivot

from .registry import query, table


@query("filter_conj", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def filter_conj(spark, d):
    o = table(spark, d, "orders")
    return o.filter(
        (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
        & in_set("o_orderpriority", "1-URGENT", "2-HIGH")
    ).select("o_orderkey", "o_custkey", "o_totalprice")


@query("filter_disj", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 400000
""")
def filter_disj(spark, d):
    o = table(spark, d, "orders")
    return o.filter((F.col("o_orderstatus") == "P") | (F.col("o_totalprice") > 400000)).select(
        "o_orderkey", "o_orderstatus", "o_totalprice"
    )


@query("in_set_nulls", """
SELECT p_partkey, code FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS code FROM part)
WHERE NOT coalesce(code IN ('PROMO', 'LARGE'), false)
""")
def in_set_nulls(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("code")
    )
    return p.filter(~in_set("code", "PROMO", "LARGE"))


@query("split_known_unknown", """
SELECT 'known' AS part, count(*) AS n, round(sum(v), 4) AS total
FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) WHERE v IS NOT NULL
UNION ALL
SELECT 'unknown', count(*), round(sum(v), 4)
FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) WHERE v IS NULL
""")
def split_known_unknown(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    known, unknown = R.split_null(e, "v")
    agg = [F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total")]
    return R.append({"known": known.agg(*agg), "unknown": unknown.agg(*agg)}, "part").select("part", "n", "total")


@query("filter_ratio_bounds", """
SELECT p_partkey, p_size, p_retailprice FROM part
WHERE p_retailprice < 50 * p_size AND p_size < 10 * p_retailprice AND p_size > 0
""")
def filter_ratio_bounds(spark, d):
    p = table(spark, d, "part")
    return p.filter(
        (F.col("p_retailprice") < 50 * F.col("p_size"))
        & (F.col("p_size") < 10 * F.col("p_retailprice"))
        & (F.col("p_size") > 0)
    ).select("p_partkey", "p_size", "p_retailprice")


@query("filter_quantile", """
SELECT event_id, value FROM events WHERE value > (SELECT quantile_cont(value, 0.9) FROM events)
""")
def filter_quantile(spark, d):
    return R.filter_above_quantile(table(spark, d, "events").select("event_id", "value"), "value", 0.9)


@query("project_rename", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer
""")
def project_rename(spark, d):
    return table(spark, d, "customer").withColumnsRenamed(
        {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"}
    ).drop("c_nationkey", "c_mktsegment")


@query("derive_chain", """
SELECT l_orderkey, round(net, 6) AS net, round(net * (1 + l_tax), 6) AS gross,
       round(net * (1 + l_tax) / (l_quantity * 7 + CAST(0.1 AS DOUBLE)), 6) AS unit_gross
FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)
""")
def derive_chain(spark, d):
    li = table(spark, d, "lineitem")
    chained = (
        li.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
        .withColumn("gross", F.col("net") * (1 + F.col("l_tax")))
        .withColumn("unit_gross", F.col("gross") / (F.col("l_quantity") * 7 + 0.1))
    )
    return R.across(chained, ["net", "gross", "unit_gross"], lambda c: F.round(c, 6)).select(
        "l_orderkey", "net", "gross", "unit_gross"
    )


@query("classify_rules", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 AND p_type IN ('PROMO', 'LARGE') THEN 'promo'
  WHEN p_size > 20 THEN 'mid' ELSE 'small' END AS class FROM part
""")
def classify_rules(spark, d):
    size = F.col("p_size")
    rules = [
        (size > 40, "big"),
        ((size > 20) & in_set("p_type", "PROMO", "LARGE"), "promo"),
        (size > 20, "mid"),
    ]
    return table(spark, d, "part").select("p_partkey", classify(rules, "small").alias("class"))


@query("flag_by_codes", """
SELECT o_orderkey, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'Freight' ELSE 'Non-Freight' END AS flag
FROM orders
""")
def flag_by_codes(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", flag_in("o_orderpriority", ["1", "2"], "Freight", "Non-Freight", prefix_len=1).alias("flag")
    )


@query("to_number_tolerant", """
SELECT event_id, TRY_CAST(CASE WHEN event_id % 11 = 0 THEN '(D)' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v
FROM events
""")
def to_number_tolerant(spark, d):
    text = F.when(F.col("event_id") % 11 == 0, "(D)").otherwise(F.col("value").cast("string"))
    return R.to_number(table(spark, d, "events").select("event_id", text.alias("v")), ["v"])


@query("clean_names", """
SELECT c_custkey AS customer_key, c_name AS customer_name, c_acctbal AS acct_balance_percent, c_mktsegment AS x2_segment
FROM customer
""")
def clean_names(spark, d):
    raw = table(spark, d, "customer").select(
        F.col("c_custkey").alias("Customer Key"),
        F.col("c_name").alias("customerName"),
        F.col("c_acctbal").alias("Acct. Balance (%)"),
        F.col("c_mktsegment").alias("2 Segment"),
    )
    return R.clean_names(raw)


@query("across_ratio", """
SELECT l_orderkey, round(l_discount / l_quantity, 4) AS l_discount, round(l_tax / l_quantity, 4) AS l_tax FROM lineitem
""")
def across_ratio(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    return R.across(li, R.columns_between(li, "l_discount", "l_tax"), lambda c: F.round(ratio(c, "l_quantity"), 4)).drop(
        "l_quantity"
    )


@query("null_fill", """
SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END, 0) AS v FROM events
""")
def null_fill(spark, d):
    return (
        table(spark, d, "events")
        .select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
        .fillna(0.0, subset=["v"])
    )


@query("keyed_overrides", """
SELECT s_suppkey, CASE WHEN n_nationkey IS NOT NULL AND s_suppkey % 2 = 0 THEN 4296.0 ELSE s_acctbal END AS s_acctbal
FROM supplier LEFT JOIN nation ON s_suppkey = n_nationkey
""")
def keyed_overrides(spark, d):
    patch = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("s_suppkey"),
        F.when(F.col("n_nationkey") % 2 == 0, F.lit(4296.0)).alias("s_acctbal"),
    )
    return R.apply_overrides(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), patch, "s_suppkey")


@query("normalize_codes", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'E' WHEN 'STANDARD' THEN 'S' WHEN 'PROMO' THEN 'P' ELSE p_type END AS code
FROM part
""")
def normalize(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", normalize_codes("p_type", {"ECONOMY": "E", "STANDARD": "S", "PROMO": "P"}).alias("code")
    )


# ---- joins ---------------------------------------------------------------------------------------------

NULL_NATION = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END"


def customers_with_gaps(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("nation")
    )


def nations_with_gap(spark, d):
    return table(spark, d, "nation").select(
        F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("key"), "n_name"
    )


@query("join_left", f"""
SELECT c_custkey, nation, n_name
FROM (SELECT c_custkey, {NULL_NATION} AS nation FROM customer)
LEFT JOIN (SELECT CASE WHEN n_nationkey <> 3 THEN n_nationkey END AS key, n_name FROM nation)
  ON nation IS NOT DISTINCT FROM key
""")
def join_left(spark, d):
    return R.left_on(customers_with_gaps(spark, d), nations_with_gap(spark, d), {"nation": "key"})


@query("join_natural", """
SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
""")
def join_natural(spark, d):
    key = F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))
    return R.natural_join(
        table(spark, d, "orders").select("o_orderkey", "o_custkey"),
        table(spark, d, "customer").select(key.alias("o_custkey"), "c_name"),
    )


@query("join_inner", """
SELECT l_orderkey, l_linenumber, p_brand, round(l_extendedprice, 4) AS price
FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def join_inner(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice", 4).alias("price")
    )
    return R.left_on(li, p, {"l_partkey": "p_partkey"}, "inner").drop("l_partkey")


@query("join_right", """
SELECT n_nationkey AS area, total FROM
  (SELECT s_nationkey, round(sum(s_acctbal), 4) AS total FROM supplier WHERE s_acctbal > 8000 GROUP BY s_nationkey)
  RIGHT JOIN nation ON s_nationkey = n_nationkey
""")
def join_right(spark, d):
    totals = (
        table(spark, d, "supplier")
        .groupBy(F.when(F.col("s_acctbal") > 8000, F.col("s_nationkey")).alias("area")).agg(F.round(F.sum("s_acctbal"), 4).alias("total"))
    )
    return R.natural_join(totals, table(spark, d, "nation").select(F.col("n_nationkey").alias("area")), "right")


@query("join_semi", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
""")
def join_semi(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_totalprice") > 450000)
    return R.keep_in(table(spark, d, "customer").select("c_custkey", "c_name"), o, {"c_custkey": "o_custkey"})


@query("join_suffix", """
SELECT a.o_custkey AS o_custkey, a.n AS n_f, b.n AS n_o
FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (o_custkey)
""")
def join_suffix(spark, d):
    o = table(spark, d, "orders")

    def counts(status):
        return o.filter(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))

    return R.join_suffix(counts("F"), counts("O"), ["o_custkey"], "_f", "_o")


@query("join_scalar", """
SELECT s_suppkey, round(s_acctbal / total, 6) AS share, n_all
FROM supplier, (SELECT sum(c_acctbal) AS total, count(*) AS n_all FROM customer)
""")
def join_scalar(spark, d):
    totals = table(spark, d, "customer").agg(F.sum("c_acctbal").alias("total"), F.count(F.lit(1)).alias("n_all"))
    return R.attach_scalar(table(spark, d, "supplier"), totals).select(
        "s_suppkey", F.round(ratio("s_acctbal", "total"), 6).alias("share"), "n_all"
    )


@query("join_labels", """
SELECT s_suppkey, n_name, r_name FROM supplier
LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def join_labels(spark, d):
    s = R.attach_labels(
        table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation"),
        {"s_nationkey": "n_nationkey"},
    )
    return R.attach_labels(s, table(spark, d, "region"), {"n_regionkey": "r_regionkey"}).select(
        "s_suppkey", "n_name", "r_name"
    )


# ---- sorts, top-k, appends -----------------------------------------------------------------------------


@query("sort_desc", """
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_orderpriority
""")
def sort_desc(spark, d):
    return (
        table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
        .orderBy(F.desc("total"), "o_orderpriority")
    )


@query("topk", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 45
""")
def topk(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
    return R.top_k(o, [F.desc("o_totalprice"), "o_orderkey"], 45)


@query("order_rank", """
SELECT p_brand, measure, row_number() OVER (ORDER BY measure DESC, p_brand) AS order_rank
FROM (SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS measure FROM part GROUP BY p_brand)
""")
def order_rank_q(spark, d):
    return order_rank(table(spark, d, "part"), "p_brand", F.sum("p_size"))


@query("union_by_name_tagged", """
SELECT s_suppkey AS id, s_acctbal AS balance, NULL AS segment, 'supplier' AS source FROM supplier
UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, 'customer' FROM customer
""")
def union_by_name_tagged(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")
    )
    return R.append({"supplier": s, "customer": c}, "source")


@query("union_text_retype", """
SELECT CAST(o_orderkey AS BIGINT) AS key,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS amount, o_orderstatus AS kind
FROM orders
UNION ALL SELECT CAST(event_id AS BIGINT), value, NULL FROM events
""")
def union_text_retype(spark, d):
    amount = F.when(F.col("o_orderkey") % 11 == 0, "error").otherwise(F.col("o_totalprice").cast("string"))
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"), amount.alias("amount"), F.col("o_orderstatus").alias("kind")
    )
    e = table(spark, d, "events").select(F.col("value").alias("amount"), F.col("event_id").alias("key"))
    return R.append_text([o, e], {"key": "bigint", "amount": "double"})


# ---- reshape -------------------------------------------------------------------------------------------


@query("unpivot_years", """
SELECT l_orderkey, name, value FROM (
  SELECT l_orderkey, 'tax' AS name, l_tax + 0.0 AS value FROM lineitem
  UNION ALL SELECT l_orderkey, 'discount', CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount + 0.0 END FROM lineitem
  UNION ALL SELECT l_orderkey, 'quantity', l_quantity FROM lineitem)
""")
def unpivot_years(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey",
        (F.col("l_tax") + 0.0).alias("tax"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount") + 0.0).alias("discount"),
        F.col("l_quantity").alias("quantity"),
    )
    return unpivot(li, ["l_orderkey"], ["tax", "discount", "quantity"], "name", "value")


@query("agg_strict_sum", """
SELECT event_type, CASE WHEN count(v) = count(*) THEN round(sum(v), 4) END AS strict_total, round(sum(v), 4) AS total
FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 AND event_type <> 'view' THEN NULL ELSE value END AS v FROM events)
GROUP BY event_type
""")
def agg_strict_sum(spark, d):
    gap = (F.col("event_id") % 7 == 0) & (F.col("event_type") != "view")
    e = table(spark, d, "events").select("event_type", F.when(~gap, F.col("value")).alias("v"))
    return e.groupBy("event_type").agg(
        F.round(strict_sum("v"), 4).alias("strict_total"), F.round(F.sum("v"), 4).alias("total")
    )
