"""End-to-end analyses on tables in the roles' shapes, derived from the driver's tables."""

from pyspark.sql import functions as F

from haulgrid import codes as C
from haulgrid.functions.geometry import length
from haulgrid.functions.scalar import strip_suffix
from haulgrid.operators.spatial import segments
from haulgrid.plans import carriers, economy, highway, population, rail
from haulgrid.session import shuffle_partitions

from .geo import CELL, CLIP
from .registry import query, table
from .shapes import (
    EDGES, PTS, SEGS, TILE_EDGES, areas, dist_sql, hit_sql, lines, points, seg_dist_sql, tiles, within_sql,
)


def rounded(df, places, *cols):
    return df.withColumns({c: F.round(c, places) for c in cols})


# ---- GDP -----------------------------------------------------------------------------------------------

YEARS = [str(y) for y in range(1995, 2002)]
PLACES = {"NATION_0": "US", **{f"NATION_{i}": "MN" if i == 1 else f"A{i}" for i in range(1, 25)}}


def gdp_wide(spark, d):
    """Order value by nation, priority and year, a year per column, some cells suppressed."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("y"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    nation = F.col("c_nationkey")

    def cell(y):
        value = F.round(F.sum(F.when(F.col("y") == int(y), F.col("o_totalprice"))), 2)
        return F.when((nation * 7 + int(y)) % 11 == 0, "(D)").otherwise(value.cast("string")).alias(y)

    wide = joined.groupBy("c_nationkey", "o_orderpriority").agg(*[cell(y) for y in YEARS])
    description = (
        F.when(F.col("o_orderpriority") == "5-LOW", "All industry total")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Government and government enterprises")
        .otherwise(F.col("o_orderpriority"))
    )
    return wide.select(
        nation.cast("string").alias("GeoFIPS"),
        F.concat(F.lit("NATION_"), nation.cast("string")).alias("GeoName"),
        F.left("o_orderpriority", F.lit(1)).alias("IndustryClassification"),
        description.alias("Description"),
        *YEARS,
    )


def gdp_labels(spark, d):
    kind = (
        F.when(F.col("o_orderpriority") == "5-LOW", "All")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Gov")
        .otherwise(F.left("o_orderpriority", F.lit(1)))
    )
    name = F.when(F.col("o_orderpriority") == "5-LOW", "All Industry Total").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select(kind.alias("IndustryClassification"), name.alias("shortname")).distinct()


def gdp_profile(spark, d):
    return economy.job_gdp_profile(
        gdp_wide(spark, d), gdp_labels(spark, d), YEARS, PLACES, codes=("All", "Gov", "1", "2"), freight=("1", "2")
    )


GDP = f"""
cell AS (SELECT c_nationkey AS nk, o_orderpriority AS pr, y.y AS yr,
  CASE WHEN (c_nationkey * 7 + y.y) % 11 = 0 THEN NULL ELSE round(sum(CASE WHEN year(o_orderdate) = y.y THEN o_totalprice END), 2) END AS v
  FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES {', '.join(f'({y})' for y in YEARS)}) y(y) GROUP BY 1, 2, 3),
coded AS (SELECT *, CASE pr WHEN '5-LOW' THEN 'All' WHEN '4-NOT SPECIFIED' THEN 'Gov' ELSE left(pr, 1) END AS code,
  CASE pr WHEN '5-LOW' THEN 'All Industry Total' ELSE pr END AS shortname,
  CASE nk WHEN 0 THEN 'US' WHEN 1 THEN 'MN' ELSE 'A' || nk END AS area FROM cell),
profile AS (SELECT nk, area, code, shortname, CAST(yr AS VARCHAR) AS yr, v IS NULL AS missing,
  coalesce(v, avg(v) OVER (PARTITION BY nk, pr)) AS v, code IN ('1', '2') AS freight FROM coded WHERE code IN ('All', 'Gov', '1', '2'))"""


@query("job_gdp_profile", f"""
WITH {GDP} SELECT CAST(nk AS VARCHAR) AS "GeoFIPS", area, code AS "IndustryClassification", shortname, yr AS "Year",
  missing AS "MissingData", round(v, 4) AS "Thousands", freight AS "FreightRel" FROM profile
""")
def job_gdp_profile(spark, d):
    return rounded(gdp_profile(spark, d), 4, "Thousands").select(
        "GeoFIPS", "area", "IndustryClassification", "shortname", "Year", "MissingData", "Thousands", "FreightRel"
    )


@query("job_gdp_mix", f"""
WITH {GDP}, pick AS (SELECT * FROM profile WHERE yr = '2000' AND area IN ('US', 'MN')),
t AS (SELECT area, max(CASE WHEN code = 'All' THEN v END) AS tot FROM pick GROUP BY 1)
SELECT area, code, shortname, round(CASE area WHEN 'MN' THEN -v / tot ELSE v / tot END, 6) AS "percGDP",
  CAST(CAST(round(v / tot * 100, 1) AS DECIMAL(18, 1)) AS VARCHAR) || '%' AS "percGDPlabel"
FROM pick JOIN t USING (area) WHERE code <> 'All'
""")
def job_gdp_mix(spark, d):
    mix = economy.job_gdp_mix(gdp_profile(spark, d), "2000", "MN", "US")
    return mix.select(
        "area", F.col("IndustryClassification").alias("code"), "shortname", F.round("percGDP", 6).alias("percGDP"), "percGDPlabel"
    )


@query("job_gdp_share", f"""
WITH {GDP} SELECT a.shortname, round(a.v / b.v, 6) AS "percUS", round(a.v / b.v * 100, 1) AS label
FROM profile a JOIN profile b ON a.code = b.code AND a.yr = b.yr WHERE a.yr = '2000' AND a.area = 'MN' AND b.area = 'US'
""")
def job_gdp_share(spark, d):
    share = economy.job_gdp_share(gdp_profile(spark, d), "2000", "MN", "US")
    return share.select("shortname", F.round("percUS", 6).alias("percUS"), "label")


# ---- job counts ----------------------------------------------------------------------------------------

N_SECTORS = len(C.JOB_SECTORS)


def jobs_block(spark, d):
    """One block per order: state, county and tract from the customer, counts from the order key."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")

    def pad(col, n):
        return F.lpad(col.cast("string"), n, "0")

    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    cns = [((key * i) % (i + 7)).alias(f"CNS{i:02d}") for i in range(1, N_SECTORS + 1)]
    return o.join(c, cust == F.col("c_custkey")).select(
        F.concat(pad(F.col("c_nationkey"), 2), pad(cust % 100, 3), pad(cust, 6), F.lit("1"), pad(key % 1000, 3)).alias("w_geocode"),
        *cns,
        sum(((key * i) % (i + 7) for i in range(1, N_SECTORS + 1)), F.lit(0)).alias("C000"),
    )


_CNS = ", ".join(f"(o_orderkey * {i}) % ({i} + 7) AS c{i}" for i in range(1, N_SECTORS + 1))
_SUMS = ", ".join(f"CAST(sum(c{i}) AS BIGINT) AS s{i}" for i in range(1, N_SECTORS + 1))
_POS = {s: i for i, s in enumerate(C.JOB_SECTORS, start=1)}
_ALL = " + ".join(f"s{i}" for i in range(1, N_SECTORS + 1))
_FREIGHT = " + ".join(f"s{_POS[s]}" for s in C.FREIGHT_JOB_SECTORS)
_GOODS = " + ".join(f"s{_POS[s]}" for s in C.GOODS_JOB_SECTORS)
JOBS = f"""
blocks AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(o_custkey % 100 AS VARCHAR), 3, '0') ||
  lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '1' AS bg, {_CNS} FROM orders JOIN customer ON o_custkey = c_custkey),
sums AS (SELECT bg, count(*) AS n, {_SUMS} FROM blocks GROUP BY 1),
roll AS (SELECT *, {_ALL} AS total, {_FREIGHT} AS freight, {_GOODS} AS goods FROM sums)"""
_NAMED = ", ".join(f's{i} AS "NAICS_{s}"' for s, i in _POS.items())


@query("job_jobs_rollup", f"""
WITH {JOBS} SELECT bg AS "BG", n AS "numBlocks", total AS "NAICS_All", {_NAMED}, freight AS "FreightEmp", goods AS "GoodsProdEmp",
  round(freight / nullif(total, 0), 6) AS "FreightProp", round(goods / nullif(total, 0), 6) AS "GoodsProp", left(bg, 5) AS county_geoid
FROM roll
""")
def job_jobs_rollup(spark, d):
    return rounded(economy.job_jobs_rollup(jobs_block(spark, d)), 6, "FreightProp", "GoodsProp")


def block_groups(spark, d):
    """A square per customer, whether it has orders or not."""
    k = F.col("c_custkey")
    side = ((k % 50 + 1) * 1000).cast("double")
    ring = F.array(*[
        F.struct((side * dx).alias("x"), (side * dy).alias("y")) for dx, dy in [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    ])
    geoid = F.concat(
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad((k % 100).cast("string"), 3, "0"),
        F.lpad(k.cast("string"), 6, "0"), F.lit("1"),
    )
    return table(spark, d, "customer").select(geoid.alias("GEOID"), F.array(ring).alias("rings"))


def job_density(spark, d):
    return economy.job_job_density(economy.job_jobs_rollup(jobs_block(spark, d)), block_groups(spark, d))


DENSITY = f"""{JOBS},
bgs AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 100 AS VARCHAR), 3, '0') ||
  lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '1' AS geoid,
  power((c_custkey % 50 + 1) * 1000.0, 2) / (5280.0 * 5280.0) AS sqmi FROM customer),
dens AS (SELECT geoid, sqmi, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(freight, 0) AS freight, coalesce(goods, 0) AS goods,
  {', '.join(f'coalesce(s{i}, 0) AS s{i}' for i in range(1, N_SECTORS + 1))} FROM bgs LEFT JOIN roll ON geoid = bg)"""


@query("job_job_density", f"""
WITH {DENSITY} SELECT geoid AS "GEOID", n AS "numBlocks", freight AS "FreightEmp", round(freight / nullif(sqmi, 0), 6) AS "FreightEmpDens",
  round(freight / nullif(total, 0), 6) AS "FreightEmpProp" FROM dens
""")
def job_job_density(spark, d):
    return rounded(job_density(spark, d), 6, "FreightEmpDens", "FreightEmpProp").select(
        "GEOID", "numBlocks", "FreightEmp", "FreightEmpDens", "FreightEmpProp"
    )


def _lq(c):
    return f"(CAST({c} AS DOUBLE) / nullif(total, 0)) / nullif(CAST(sum({c}) OVER () AS DOUBLE) / nullif(sum(total) OVER (), 0), 0)"


@query("job_lq_area", f"""
WITH {DENSITY} SELECT geoid AS "GEOID", freight AS "FreightEmp",
  {', '.join(f'round({_lq(f"s{i}")}, 6) AS "LQ_NAICS_{s}"' for s, i in _POS.items())},
  round({_lq('freight')}, 6) AS "LQ_FreightEmp", round({_lq('goods')}, 6) AS "LQ_GoodsProdEmp" FROM dens
""")
def job_lq_area(spark, d):
    lq = economy.job_lq_area(job_density(spark, d))
    return rounded(lq, 6, *[c for c in lq.columns if c.startswith("LQ_")])


# ---- establishments ------------------------------------------------------------------------------------

CODES = {"ECONOMY": "11", "LARGE": "31-33", "STANDARD": "44-45", "PROMO": "48-49", "SMALL": "52", "MEDIUM": "72"}


def _coded_parts(spark, d):
    p = table(spark, d, "part")
    code = F.lit(None)
    for kind, value in CODES.items():
        code = F.when(F.col("p_type") == kind, value).otherwise(code)
    brand = F.substring("p_brand", 7, 2).cast("int")
    base = F.left(code, F.lit(2))
    fine = [F.concat(base, (brand % 10).cast("string")), F.concat(base, F.lpad(brand.cast("string"), 2, "0"))]
    return p.select("p_partkey", "p_type", F.explode(F.array(F.lit("00"), code, *fine)).alias("code"))


def _line_codes(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    # one row per part and supplier before the codes multiply rows
    summed = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    located = summed.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return located.select(
        F.lpad(F.col("s_nationkey").cast("string"), 3, "0").alias("county"),
        F.lpad(F.col("n_regionkey").cast("string"), 2, "0").alias("state"),
        "l_partkey", "q", "n",
    ).join(_coded_parts(spark, d).drop("p_type"), F.col("l_partkey") == F.col("p_partkey"))


def establishments(spark, d, by=("county", "state")):
    """Rows per area and code at every code length, as text, with a duplicate set for one size class."""
    sums = _line_codes(spark, d).groupBy(*by, "code").agg(F.sum("q").cast("bigint").alias("q"), F.sum("n").alias("n"))
    hidden = (F.col("code") == "52") & (F.col("county") == "003") if by else F.lit(False)
    return sums.select(
        *by,
        F.col("q").cast("string").alias("EMP"),
        F.col("n").cast("string").alias("ESTAB"),
        F.when(hidden, "(D)").otherwise((F.col("q") * 10).cast("string")).alias("PAYANN"),
        F.col("code").alias("NAICS2017"),
        F.lit("2021").alias("YEAR"),
        F.explode(F.array(F.lit("001"), F.lit("210"))).alias("EMPSZES"),
    )


def counties(spark, d):
    n = table(spark, d, "nation")
    return n.select(
        F.lpad(F.col("n_regionkey").cast("string"), 2, "0").alias("state"),
        F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("county"),
        F.col("n_name").alias("NAME"),
    )


def titles(spark, d):
    raw = _coded_parts(spark, d).groupBy(F.col("code").alias("Code")).agg(F.concat(F.min("p_type"), F.lit("T")).alias("Title"))
    return raw.withColumn("Title", strip_suffix("Title", "T"))


def sector_labels(spark, d):
    return table(spark, d, "part").select(
        F.col("p_type").alias("shortname"),
        F.left(F.coalesce(*[F.when(F.col("p_type") == k, F.lit(v)) for k, v in CODES.items()]), F.lit(2)).alias("NAICS2"),
    ).distinct()


_CASE = " ".join(f"WHEN '{k}' THEN '{v[:2]}'" for k, v in CODES.items())
EST = f"""
pc AS (SELECT p_partkey, p_type, base, unnest(['00', base, base || CAST(b % 10 AS VARCHAR), base || lpad(CAST(b AS VARCHAR), 2, '0')]) AS code
  FROM (SELECT p_partkey, p_type, CASE p_type {_CASE} END AS base, CAST(substr(p_brand, 7, 2) AS INT) AS b FROM part)),
titles AS (SELECT code, min(p_type) AS title FROM pc GROUP BY 1),
est AS (SELECT n_regionkey AS region, s_nationkey AS nk, code, CAST(sum(l_quantity) AS BIGINT) AS emp, count(*) AS estab,
  CASE WHEN code = '52' AND s_nationkey = 3 THEN NULL ELSE CAST(sum(l_quantity) AS BIGINT) * 10 END AS pay
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN pc ON l_partkey = p_partkey
  GROUP BY 1, 2, 3)"""
SECTORS = f"""{EST},
sectors AS (SELECT code, any_value(title) AS shortname, CASE WHEN code = '52' THEN 'Non-Freight' ELSE 'Freight' END AS kind,
  CAST(sum(emp) AS DOUBLE) AS emp, CAST(sum(estab) AS DOUBLE) AS estab,
  CASE WHEN count(pay) = count(*) THEN CAST(sum(pay) AS DOUBLE) END AS pay
  FROM est JOIN titles USING (code) WHERE length(code) <= 2 AND code <> '00' AND region = 3 GROUP BY 1)"""


def sectors(spark, d):
    """Sectors over the counties of one state, state and county matched together."""
    home = counties(spark, d).filter(F.col("state") == "03")
    return economy.job_establishments(establishments(spark, d), home, sector_labels(spark, d))


@query("job_establishments", f"""
WITH {SECTORS} SELECT code AS "NAICS", '2021' AS "YEAR", kind AS "FreightRelated", emp, estab, pay, shortname FROM sectors
""")
def job_establishments(spark, d):
    return sectors(spark, d)


@query("job_establishments_by_kind", f"""
WITH {SECTORS} SELECT kind AS "FreightRelated", sum(emp) AS emp, sum(estab) AS estab,
  CASE WHEN count(pay) = count(*) THEN sum(pay) END AS pay FROM sectors GROUP BY 1
""")
def job_establishments_by_kind(spark, d):
    return economy.establishments_by_kind(sectors(spark, d))


@query("job_establishments_share", f"""
WITH {SECTORS} SELECT '2021' AS "YEAR", round(sum(CASE WHEN kind = 'Freight' THEN emp END) / sum(emp), 8) AS share FROM sectors
""")
def job_establishments_share(spark, d):
    return rounded(economy.freight_share(sectors(spark, d)), 8, "share")


def quotients(spark, d, depth):
    return economy.job_lq_rollup(establishments(spark, d), F.col("state") == "00", titles(spark, d), depth)


def lq_sql(depth):
    return f"""{EST},
mine AS (SELECT code, CAST(sum(emp) AS DOUBLE) AS x FROM est WHERE region = 0 GROUP BY 1),
us AS (SELECT code, CAST(sum(emp) AS DOUBLE) AS y FROM est GROUP BY 1),
lq AS (SELECT code, title, x, (SELECT x FROM mine WHERE code = '00') AS dx, y, (SELECT y FROM us WHERE code = '00') AS dy
  FROM mine JOIN us USING (code) LEFT JOIN titles USING (code) WHERE length(code) = {depth} AND code <> '00')"""


LQ_COLUMNS = """code AS "NAICS", title AS "Title", x AS "EMP_x", dx AS "denom_x", y AS "EMP_y", dy AS "denom_y",
  round((x / dx) / (y / dy), 8) AS "LQ", CASE WHEN left(code, 2) = '52' THEN 'Non-Freight' ELSE 'Freight' END AS "FreightRel" """


@query("job_lq_depth", f"WITH {lq_sql(4)} SELECT {LQ_COLUMNS} FROM lq")
def job_lq_depth(spark, d):
    return rounded(quotients(spark, d, 4), 8, "LQ")


@query("job_lq_top", f"""
WITH {lq_sql(3)}, r AS (SELECT *, row_number() OVER (ORDER BY (x / dx) / (y / dy) DESC, code) AS k FROM lq WHERE left(code, 2) <> '52')
SELECT {LQ_COLUMNS} FROM r WHERE k <= 10
""")
def job_lq_top(spark, d):
    return rounded(economy.top_quotients(quotients(spark, d, 3)), 8, "LQ")


LEADER = f"""{EST},
subs AS (SELECT left(code, 2) AS n2, code, CAST(sum(emp) AS DOUBLE) AS tot FROM est WHERE length(code) = 4 GROUP BY 1, 2)"""


@query("job_sector_leader", f"""
WITH {LEADER}, lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n2 ORDER BY tot DESC, code) AS k FROM subs) WHERE k = 1)
SELECT n2 AS "NAICS2", code AS "NAICS", title AS "Title", tot AS "empTot", lpad(CAST(region AS VARCHAR), 2, '0') AS state,
  lpad(CAST(nk AS VARCHAR), 3, '0') AS county, CAST(emp AS DOUBLE) AS "EMP", n_name AS "NAME"
FROM lead JOIN est USING (code) JOIN nation ON nk = n_nationkey LEFT JOIN titles USING (code)
""")
def job_sector_leader(spark, d):
    return economy.job_sector_leader(establishments(spark, d), titles(spark, d), counties(spark, d))


@query("job_sector_order", f"""
WITH {LEADER} SELECT code AS "NAICS", tot AS measure, row_number() OVER (ORDER BY tot DESC, code) AS order_rank FROM subs
""")
def job_sector_order(spark, d):
    return economy.sub_sector_order(economy.sub_sectors(establishments(spark, d), titles(spark, d)))


# ---- population ----------------------------------------------------------------------------------------

VARIABLES = population.variables()


def acs_tidy(spark, d):
    """Every customer is an area with an estimate per variable, a few of them missing.

    The keys are dealt to tasks first, as many rows are made of a table that may be one short file.
    """
    k = F.col("c_custkey")
    entries = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.lit(i).alias("i")) for i, v in enumerate(VARIABLES)
    ])
    dealt = table(spark, d, "customer").select(k).repartition(shuffle_partitions(spark), k)
    e = dealt.select(k, F.explode(entries).alias("e"))
    i = F.col("e.i")
    estimate = F.when((k + i) % 97 != 0, ((k * 13 + i * 7) % 500).cast("double"))
    return e.select(k.cast("string").alias("GEOID"), F.col("e.variable").alias("variable"), estimate.alias("estimate"))


def acs_areas(spark, d):
    return block_groups(spark, d).select(F.substring("GEOID", 6, 6).cast("bigint").cast("string").alias("GEOID"), "rings")


def _est(v):
    i = VARIABLES.index(v)
    return f"CASE WHEN (c_custkey + {i}) % 97 = 0 THEN NULL ELSE (c_custkey * 13 + {i * 7}) % 500 END"


def _est_sum(names):
    return "(" + " + ".join(_est(v) for v in names) + ")"


def _share(numerator, base):
    return f"round(CAST({numerator} AS DOUBLE) / nullif({_est(population.DENOMINATORS[base])}, 0), 4)"


def _demographics_sql():
    den = population.DENOMINATORS
    cols = {k: f"CAST({_est(v)} AS DOUBLE)" for k, v in den.items()}
    cols.update({k: _share(_est_sum(v), "totPop") for k, v in population.TOTAL_BASED.items()})
    cols["minority"] = _share(f"({_est(den['totPop'])} - {_est('B03002_003')})", "totPop")
    cols["pov100"] = _share(_est_sum(C.ACS_POV100), "totFam")
    cols["pov185"] = _share(_est_sum(C.ACS_POV185), "totFam")
    cols["LEP"] = _share(f"({_est(den['totPop5above'])} - {_est_sum(C.ACS_ENGLISH)})", "totPop5above")
    cols["disab"] = _share(_est_sum(C.ACS_DISABLED), "totCivNonInstPop")
    cols["zeroVeh"] = _share(_est_sum(("B25044_003", "B25044_010")), "occHU")
    cols.update({k: _share(_est(v), "totWork16") for k, v in population.WORKER_BASED.items()})
    cols["areaSM"] = "round(power((c_custkey % 50 + 1) * 1000.0, 2) / (5280.0 * 5280.0), 2)"
    cols["popDensity"] = f"round({cols['totPop']} / nullif({cols['areaSM']}, 0), 0)"
    return 'SELECT CAST(c_custkey AS VARCHAR) AS "GEOID", ' + ", ".join(f'{e} AS "{k}"' for k, e in cols.items()) + " FROM customer"


@query("job_demographics", _demographics_sql())
def job_demographics(spark, d):
    return population.job_demographics(acs_tidy(spark, d), acs_areas(spark, d))


def new_areas(spark, d):
    k = F.col("area")
    return tiles(spark, d).select(
        F.concat(F.lit("N"), k.cast("string")).alias("GEOID"), (k * 100 + 50).cast("double").alias("estimate"), "rings"
    )


def old_areas(spark, d):
    """A small square around every customer's point; some estimates are missing."""
    ring = F.array(*[
        F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
        for dx, dy in [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    ])
    return points(spark, d).select(
        F.concat(F.lit("N"), F.col("id").cast("string")).alias("GEOID"),
        F.when(F.col("id") % 401 != 0, (F.col("id") % 90).cast("double")).alias("estimate"), F.array(ring).alias("rings"),
    )


def overrides(spark, d):
    return table(spark, d, "region").filter(F.col("r_name") == "AFRICA").select(
        F.lit("N24").alias("GEOID_new"), F.lit(4296.0).alias("pop_old"), F.lit(4367.0).alias("pop_new")
    )


@query("job_population_change", f"""
WITH {PTS}, {TILE_EDGES}, est AS (SELECT id, x, y, CASE WHEN id % 401 = 0 THEN NULL ELSE CAST(id % 90 AS DOUBLE) END AS e FROM pts),
hit AS (SELECT area, id FROM est JOIN tile_edges ON (y1 <= y) <> (y2 <= y)
  AND x1 + (y - y1) * (x2 - x1) / (y2 - y1) < x GROUP BY 1, 2 HAVING count(*) % 2 = 1),
walk AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey = 24 THEN 4296.0 WHEN count(e) = count(*) THEN sum(e) END AS pop_old,
  CAST(CASE WHEN n_nationkey = 24 THEN 4367 ELSE n_nationkey * 100 + 50 END AS DOUBLE) AS pop_new
  FROM nation LEFT JOIN (SELECT area, e FROM hit JOIN est USING (id)) h ON h.area = n_nationkey GROUP BY 1)
SELECT 'N' || id AS "GEOID", e AS estimate, pop_old, pop_new, round((pop_new - pop_old) / nullif(pop_old, 0), 6) AS "percChange",
  pop_new - pop_old AS change FROM est LEFT JOIN walk ON id = k
""")
def job_population_change(spark, d):
    out = population.job_population_change(old_areas(spark, d), new_areas(spark, d), overrides=overrides(spark, d))
    return rounded(out, 6, "percChange")


@query("job_population_total", """
SELECT pop_old, pop_new, pop_new - pop_old AS change, round(pop_new / pop_old, 8) AS growth FROM
 (SELECT CAST(sum(c_custkey % 90) AS DOUBLE) AS pop_old FROM customer),
 (SELECT CAST(sum(n_nationkey * 100 + 50) AS DOUBLE) AS pop_new FROM nation)
""")
def job_population_total(spark, d):
    old = table(spark, d, "customer").select((F.col("c_custkey") % 90).cast("double").alias("estimate"))
    return rounded(population.total_change(old, new_areas(spark, d)), 8, "growth")


# ---- highway -------------------------------------------------------------------------------------------


@query("job_truck_share", """
WITH t AS (SELECT 'TH ' || (o_custkey % 100) AS route, o_totalprice * (o_orderkey % 10) / 10 AS trucks,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_totalprice END AS adt FROM orders)
SELECT route AS "ROUTE_LABE", round(avg(trucks), 4) AS "avgTrucks", round(avg(trucks / nullif(adt, 0)), 6) AS "avgTruckP" FROM t GROUP BY 1
""")
def job_truck_share(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    adt = o.select(
        F.when(F.col("o_orderstatus") != "P", key).alias("SEQUENCE_N"), F.when(key % 13 != 0, F.col("o_totalprice")).otherwise(0.0).alias("CURRENT_VO")
    )
    trucks = o.select(
        key.alias("SEQUENCE_N"), F.concat(F.lit("TH "), (F.col("o_custkey") % 100).cast("string")).alias("ROUTE_LABE"),
        (F.col("o_totalprice") * (key % 10) / 10).alias("CURRENT_VO"),
    )
    out = highway.job_truck_share(adt, trucks)
    return out.select("ROUTE_LABE", F.round("avgTrucks", 4).alias("avgTrucks"), F.round("avgTruckP", 6).alias("avgTruckP"))


def segment_results(spark, d):
    """Raw service headers, everything text; a missing speed is skipped, a missing flow factor voids its zone."""
    li = table(spark, d, "lineitem")
    key = F.col("l_orderkey")
    return li.select(
        F.col("l_partkey").cast("string").alias("Zone ID"),
        F.col("l_returnflag").alias("Vehicle Weight"),
        F.when(F.col("l_linestatus") == "O", highway.DAY_TYPE).otherwise("0: All Days").alias("Day Type"),
        F.lit(highway.DAY_PART).alias("Day Part"),
        F.col("l_extendedprice").cast("string").alias("Average Daily Segment Traffic (StL Index)"),
        F.when(key % 7 == 0, "NA").otherwise(F.col("l_quantity").cast("string")).alias("Avg Segment Speed (mph)"),
        F.when(key % 97 == 0, "NA").otherwise((1 - F.col("l_discount") * 4).cast("string")).alias("Free Flow Factor"),
    )


def zone_lines(spark, d):
    k = F.col("p_partkey")
    a = F.struct(((k * 37) % 1000).cast("double").alias("x"), ((k * 91) % 1000).cast("double").alias("y"))
    b = F.struct((a["x"] + k % 50).alias("x"), a["y"].alias("y"))
    return table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("name"), F.array(a, b).alias("line"))


def segment_delay(spark, d):
    return highway.job_segment_delay(segment_results(spark, d), zone_lines(spark, d), src=6501, dst=6501)


DELAY = """
flow AS (SELECT l_partkey AS zone, sum(l_extendedprice) AS idx,
  sum(l_extendedprice * CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END) AS spd,
  CASE WHEN count(CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE 1 END) = count(*) THEN sum(l_extendedprice * (1 - l_discount * 4)) END AS fff
  FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
ranked AS (SELECT *, (rank() OVER (ORDER BY round(idx, 2)) - 1) / (count(*) OVER () - 1) AS pr FROM flow),
delay AS (SELECT zone AS zone_id, idx, pr, coalesce(spd, 0) / idx AS spd, fff / idx AS fff, p_name AS name,
  CAST(p_partkey % 50 AS DOUBLE) AS len, (1 - fff / idx) * idx AS di
  FROM ranked LEFT JOIN part ON zone = p_partkey WHERE fff / idx > 0 AND idx >= 0)"""


@query("job_segment_delay", f"""
WITH {DELAY} SELECT zone_id, round(idx, 2) AS "stlIndex", round(pr, 6) AS "percRank", round(spd, 6) AS "avgSpd",
  round(fff, 6) AS "FFF", name, round(len, 4) AS "lengthFeet", round(di, 2) AS delay_index FROM delay
""")
def job_segment_delay(spark, d):
    out = rounded(segment_delay(spark, d), 2, "stlIndex", "delay_index")
    return rounded(rounded(out, 6, "percRank", "avgSpd", "FFF"), 4, "lengthFeet")


@query("job_bottlenecks", f"""
WITH {DELAY} SELECT zone_id, round(idx, 2) AS "stlIndex", round(spd, 6) AS "avgSpd", round(fff, 6) AS "FFF", name,
  round(len, 4) AS "lengthFeet" FROM delay WHERE idx > (SELECT quantile_cont(idx, 0.5) FROM delay) AND fff < 0.8
""")
def job_bottlenecks(spark, d):
    out = highway.job_bottlenecks(segment_delay(spark, d))
    return rounded(rounded(rounded(out, 2, "stlIndex"), 6, "avgSpd", "FFF"), 4, "lengthFeet")


@query("job_delay_hotspots", f"""
WITH {DELAY} SELECT zone_id, round(di, 2) AS delay_index FROM delay WHERE di > (SELECT quantile_cont(di, 0.9) FROM delay)
""")
def job_delay_hotspots(spark, d):
    return highway.delay_hotspots(segment_delay(spark, d)).select("zone_id", F.round("delay_index", 2).alias("delay_index"))


def road_lines(spark, d):
    """A short two-vertex line per customer."""
    return points(spark, d).select(
        F.col("id").alias("zone_name"),
        F.array(
            F.struct("x", "y"),
            F.struct((F.col("x") + F.col("id") % 40).alias("x"), (F.col("y") + F.col("id") % 30).alias("y")),
        ).alias("line"),
    )


def network(spark, d):
    """One layer cut to the areas, one taken whole."""
    layers = lines(spark, d, "s_acctbal")
    boundary = areas(spark, d).select(F.col("area").alias("area_id"), "rings")
    return highway.freight_network(
        {"NHFN": layers.filter("s_acctbal >= 5000")}, {"TH": layers.filter("s_acctbal < 5000")}, boundary, CELL
    )


NETWORK = f"""{PTS}, {SEGS}, {EDGES}, {CLIP},
mid AS (SELECT line_id, seg, t, t1, x, y FROM parts),
{hit_sql('hit', 'mid', 'line_id, seg, t, t1')},
net AS (SELECT 'NHFN' AS source, x1 + t * (x2 - x1) AS x1, y1 + t * (y2 - y1) AS y1, x1 + t1 * (x2 - x1) AS x2, y1 + t1 * (y2 - y1) AS y2
    FROM hit JOIN segs USING (line_id, seg) WHERE s_acctbal >= 5000
  UNION ALL SELECT 'TH', x1, y1, x2, y2 FROM segs WHERE s_acctbal < 5000)"""


@query("job_network_length", f"""
WITH {NETWORK} SELECT source, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 3) AS len FROM net GROUP BY 1
""")
def job_network_length(spark, d):
    return network(spark, d).groupBy("source").agg(
        F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 3).alias("len")
    )


@query("job_network_lines", f"""
WITH {NETWORK}, ends AS (SELECT id, x, y FROM pts UNION ALL SELECT id, x + id % 40, y + id % 30 FROM pts),
near AS (SELECT id, ends.x, ends.y, min({dist_sql('ends.x', 'ends.y', 'net.')}) <= 12 AS ok FROM ends, net GROUP BY 1, 2, 3)
SELECT id AS zone_name FROM near GROUP BY 1 HAVING bool_and(ok)
""")
def job_network_lines(spark, d):
    return highway.job_network_lines(road_lines(spark, d), network(spark, d), 12.0).select("zone_name")


def lon_lat_lines(spark, d):
    ll = F.transform("line", lambda p: F.struct((p["x"] * 0.00007 - 94).alias("x"), (p["y"] * 0.000055 + 45).alias("y")))
    return road_lines(spark, d).select("zone_name", ll.alias("line"))


def zone_batches(spark, d):
    return highway.job_zone_batches(lon_lat_lines(spark, d), "FreightZone", size=100)


_A = "radians(45 + 0.000055 * y)"
_B = "radians(45 + 0.000055 * (y + id % 30))"
_DL = "radians(0.00007 * (id % 40))"
ZONES = f"""{PTS},
z AS (SELECT id, 2 * 6371010.0 * asin(sqrt(power(sin(({_B} - {_A}) / 2), 2) + cos({_A}) * cos({_B}) * power(sin({_DL} / 2), 2))) AS m,
  CAST(trunc(degrees(atan2(sin({_DL}) * cos({_B}), cos({_A}) * sin({_B}) - sin({_A}) * cos({_B}) * cos({_DL})))) AS INT) AS b FROM pts),
zr AS (SELECT *, row_number() OVER (ORDER BY id) AS row_num FROM z WHERE m > 100),
zb AS (SELECT *, CAST(ceil(row_num / 100.0) AS INT) AS batch FROM zr)"""


@query("job_zone_batches", f"""
WITH {ZONES} SELECT row_num, id AS name, 1 AS is_pass, CASE WHEN b <= 0 THEN b + 360 ELSE b END AS direction, round(m, 3) AS len_metres,
  batch, 'FreightZone_' || batch || '_of_' || (SELECT max(batch) FROM zb) AS batch_name FROM zb
""")
def job_zone_batches(spark, d):
    return rounded(zone_batches(spark, d), 3, "len_metres").drop("id", "line")


@query("job_zone_requests", f"""
WITH {ZONES} SELECT batch, count(*) AS n_rows, count(*) AS n_features, min(id) AS first_name FROM zb GROUP BY 1
""")
def job_zone_requests(spark, d):
    body = "zone_set_name string, zones array<struct<geometry:struct<coordinates:array<array<double>>>,properties:struct<name:bigint>>>"
    requests = highway.zone_requests(zone_batches(spark, d)).select("batch", "n_rows", F.from_json("body", body).alias("b"))
    return requests.select(
        "batch", "n_rows", F.size("b.zones").cast("bigint").alias("n_features"), F.col("b.zones")[0]["properties"]["name"].alias("first_name")
    )


@query("job_split_zones", f"""
WITH {SEGS}, net AS (SELECT x1, y1, x2, y2 FROM segs WHERE s_acctbal >= 5000), {within_sql('kept', 60)},
tot AS (SELECT line_id, sum(len) AS total FROM segs GROUP BY 1),
z AS (SELECT line_id, unnest(range(1, 1 + CAST(ceil(total / 66) AS INT))) AS part, total / ceil(total / 66) AS len
  FROM tot JOIN kept USING (line_id) WHERE total > 100)
SELECT row_number() OVER (ORDER BY line_id, part) AS row_num, CAST(line_id AS VARCHAR) || '_' || (row_number() OVER (ORDER BY line_id, part)) AS name,
  line_id AS segment_id, CAST(part AS INT) AS part, round(len, 4) AS len, CAST(ceil(row_number() OVER (ORDER BY line_id, part) / 50.0) AS INT) AS batch FROM z
""")
def job_split_zones(spark, d):
    roads = lines(spark, d, "s_acctbal").withColumnRenamed("line_id", "segment_id")
    net = segments(roads.filter("s_acctbal >= 5000"), "line", [])
    zones = highway.job_split_zones(roads.drop("s_acctbal"), net, "Study", d=60.0, min_len=100.0, max_len=66.0, size=50)
    return zones.select("row_num", "name", "segment_id", "part", F.round(length("line"), 4).alias("len"), "batch")


# ---- rail ----------------------------------------------------------------------------------------------

SUFFIXES = ["CEDR", "DME", "PGR", "SOO", "UP", "CP", "BNSF"]


def inventory(spark, d):
    """One crossing per order, every rule input derived from its key."""
    k = F.col("o_orderkey")

    def gap(col, n):
        return F.when(k % n != 0, col)

    names = F.array(*[F.lit(s) for s in SUFFIXES])
    return table(spark, d, "orders").select(
        k.cast("string").alias("CrossingID"),
        F.get(names, (k % 7).cast("int")).alias("CrossingIdSuffix"),
        F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("PosXing"),
        gap(k % 20, 23).alias("ReasonID"),
        (k % 3 + 1).alias("TypeXing"),
        gap(k % 4, 29).alias("XPurpose"),
        gap(k % 5, 31).alias("GateConf"),
        gap(k % 2 * (k % 3), 37).alias("Gates"),
        (k % 6).alias("Channel"),
        gap(k % 2, 41).alias("FlashPai"),
        ((k / 2).cast("bigint") % 2).alias("StopStd"),
        ((k / 4).cast("bigint") % 2).alias("XBuck"),
        gap(k % 3, 43).alias("Whistban"),
        gap(((k * 91) % 1000).cast("double"), 47).alias("Latitude"),
        ((k * 37) % 1000).cast("double").alias("Longitude"),
        (k % 17).alias("DayThru"),
        gap(k % 11, 53).alias("NghtThru"),
        (k % 8 * 10).alias("MaxTtSpd"),
    )


def crossings(spark, d):
    return rail.job_crossings(
        inventory(spark, d), areas(spark, d).drop("n_name"), rail.owner_table(spark), src=6501, dst=6501
    )


_OWNERS = ", ".join(f"('{a}', '{b}')" for a, b in C.RAIL_OWNERS)
XINGS = f"""{EDGES},
inv AS (SELECT o_orderkey AS k, [{', '.join(f"'{s}'" for s in SUFFIXES)}][o_orderkey % 7 + 1] AS suffix, o_orderstatus,
  CASE WHEN o_orderkey % 23 <> 0 THEN o_orderkey % 20 END AS reason, o_orderkey % 3 + 1 AS tx,
  CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey % 4 END AS xp, CASE WHEN o_orderkey % 31 <> 0 THEN o_orderkey % 5 END AS gc,
  CASE WHEN o_orderkey % 37 <> 0 THEN o_orderkey % 2 * (o_orderkey % 3) END AS gates, o_orderkey % 6 AS ch,
  CASE WHEN o_orderkey % 41 <> 0 THEN o_orderkey % 2 END AS fl, o_orderkey // 2 % 2 AS st, o_orderkey // 4 % 2 AS xb,
  CASE WHEN o_orderkey % 43 <> 0 THEN o_orderkey % 3 END AS wb,
  CASE WHEN o_orderkey % 47 <> 0 THEN CAST((o_orderkey * 91) % 1000 AS DOUBLE) END AS y, CAST((o_orderkey * 37) % 1000 AS DOUBLE) AS x,
  o_orderkey % 17 + CASE WHEN o_orderkey % 53 <> 0 THEN o_orderkey % 11 END AS trains, o_orderkey % 8 * 10 AS speed FROM orders),
kept AS (SELECT * FROM inv WHERE o_orderstatus <> 'P' AND reason <> 16 AND y IS NOT NULL),
{hit_sql('inside', 'kept', 'k')},
xing AS (SELECT kept.*, area, rr, CASE WHEN tx = 3 AND xp = 1 THEN 'PubHwy' WHEN tx = 2 THEN 'Priv' WHEN tx = 3 AND xp > 1 THEN 'PubPed' END AS kind,
  CASE WHEN gc = 3 THEN 'FourQuad' WHEN gates > 0 AND ch IN (1, 2, 3, 4) THEN 'GatesWithMedian' WHEN gates > 0 THEN 'Gates'
    WHEN fl > 0 AND gates = 0 THEN 'FlashingOnly' WHEN gates = 0 AND fl = 0 AND st > 0 THEN 'StopSign'
    WHEN gates = 0 AND fl = 0 AND st = 0 AND xb > 0 THEN 'Crossbuck' ELSE 'Unknown' END AS dev,
  CASE WHEN wb = 1 THEN 'QZ' WHEN wb = 0 OR wb IS NULL THEN 'Horns Sound' END AS qz
  FROM kept JOIN inside USING (k) LEFT JOIN (VALUES {_OWNERS}) o(suffix, rr) USING (suffix))"""


@query("job_crossings", f"""
WITH {XINGS} SELECT CAST(k AS VARCHAR) AS "CrossingID", area, kind AS "Type", dev AS "WarnDev", qz AS "QZ", rr AS "RRname", trains AS "trainTot" FROM xing
""")
def job_crossings(spark, d):
    return crossings(spark, d).select("CrossingID", "area", "Type", "WarnDev", "QZ", "RRname", "trainTot")


def rail_lines(spark, d):
    """Supplier lines with owner and network class."""
    k = F.col("line_id")
    nets = F.array(*[F.lit(n) for n in ("M", "M", "M", "O", "I", "S", "Y")])
    return lines(spark, d).select(
        k.alias("OBJECTID"), F.get(nets, (k % 7).cast("int")).alias("NET"),
        F.when(k % 11 != 0, F.get(F.array(*[F.lit(s) for s in ("CN", "CPRS", "PGR", "UP", "BNSF")]), (k % 5).cast("int"))).alias("RROWNER1"),
        "line",
    )


def _point_crossings(spark, d):
    """Crossings for the volume job, all in the south, so that some lines stay without one."""
    k = F.col("id")
    return points(spark, d).withColumn("y", F.col("y") * 0.75).select(
        k.alias("CrossingID"), F.when(k % 9 != 0, k % 7).alias("trainTot"), (k % 5 * 10).alias("MaxTtSpd"), "x", "y"
    )


@query("job_rail_volume", f"""
WITH {PTS}, {SEGS},
x AS (SELECT id, x, y * CAST(0.75 AS DOUBLE) AS y, CASE WHEN id % 9 <> 0 THEN id % 7 END AS trains, id % 5 * 10 AS speed FROM pts),
d1 AS (SELECT id, line_id, min({dist_sql('x', 'y')}) AS dist FROM x, segs GROUP BY 1, 2),
near AS (SELECT id, line_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, line_id) AS r FROM d1) WHERE r = 1),
mt AS (SELECT line_id, trains FROM (SELECT line_id, trains, row_number() OVER (PARTITION BY line_id ORDER BY count(*) DESC, trains NULLS LAST) AS r
  FROM near JOIN x USING (id) GROUP BY 1, 2) WHERE r = 1),
ms AS (SELECT line_id, speed FROM (SELECT line_id, speed, row_number() OVER (PARTITION BY line_id ORDER BY count(*) DESC, speed NULLS LAST) AS r
  FROM near JOIN x USING (id) GROUP BY 1, 2) WHERE r = 1),
main AS (SELECT s_suppkey AS line_id, trains, speed FROM supplier LEFT JOIN mt ON s_suppkey = mt.line_id LEFT JOIN ms ON s_suppkey = ms.line_id
  WHERE s_suppkey % 7 < 3),
d2 AS (SELECT a.line_id, b.line_id AS known, min({seg_dist_sql('a.', 'b.')}) AS dist FROM segs a, segs b
  WHERE a.line_id IN (SELECT line_id FROM main WHERE trains IS NULL) AND b.line_id IN (SELECT line_id FROM main WHERE trains IS NOT NULL) GROUP BY 1, 2),
fill AS (SELECT d.line_id, m.trains AS ty, m.speed AS sy FROM (
  SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY dist, known) AS r FROM d2) d JOIN main m ON m.line_id = d.known WHERE r = 1)
SELECT line_id AS "OBJECTID", CASE WHEN trains IS NULL THEN ty WHEN ty IS NULL THEN trains ELSE greatest(trains, ty) END AS trains,
  CASE WHEN speed IS NULL THEN sy WHEN sy IS NULL THEN speed ELSE greatest(speed, sy) END AS speed
FROM main LEFT JOIN fill USING (line_id)
""")
def job_rail_volume(spark, d):
    return rail.job_rail_volume(_point_crossings(spark, d), rail_lines(spark, d))


CROSS_COUNTS = """count(*) FILTER (kind = 'PubHwy') AS "Public Highway Crossing", count(*) FILTER (kind = 'PubPed') AS "Public Pedestrian Crossing",
  count(*) FILTER (kind = 'Priv') AS "Private", count(*) FILTER (kind IS NOT NULL) AS "Total Grade Crossings" """


@query("job_crossing_table", f"""WITH {XINGS} SELECT rr AS "Railroad", {CROSS_COUNTS} FROM xing GROUP BY 1""")
def job_crossing_table(spark, d):
    return rail.job_crossing_table(crossings(spark, d))


_NETS = ", ".join(f"""coalesce(sum(mi) FILTER (net = '{k}'), 0) AS "{v}" """ for k, v in rail.NET_NAMES.items())
_SUMMED = ", ".join(
    f'sum("{c}") AS "{c}"' for c in [*rail.NET_NAMES.values(), "Total Miles"]
) + ", " + ", ".join(
    f'CAST(sum("{c}") AS BIGINT) AS "{c}"'
    for c in ("Public Highway Crossing", "Public Pedestrian Crossing", "Private", "Total Grade Crossings")
)


@query("job_track_table", f"""
WITH {SEGS}, {XINGS}, ct AS (SELECT rr, {CROSS_COUNTS} FROM xing GROUP BY 1),
ln AS (SELECT line_id, sum(len) AS miles, ['M', 'M', 'M', 'O', 'I', 'S', 'Y'][line_id % 7 + 1] AS net,
  ['CN', 'CPRS', 'PGR', 'UP', 'BNSF'][line_id % 5 + 1] AS owner FROM segs WHERE line_id % 11 <> 0 GROUP BY 1),
m AS (SELECT owner, net, round(sum(miles), 0) AS mi FROM ln GROUP BY 1, 2),
w AS (SELECT owner, {_NETS}, sum(mi) AS "Total Miles" FROM m GROUP BY 1),
j AS (SELECT owner AS "Railroad", w.* EXCLUDE (owner), ct.* EXCLUDE (rr) FROM w LEFT JOIN ct ON owner = rr)
SELECT * FROM j UNION ALL BY NAME SELECT NULL AS "Railroad", {_SUMMED} FROM j
""")
def job_track_table(spark, d):
    # coordinates as miles, so that the totals are worth rounding
    stretched = rail_lines(spark, d).withColumn(
        "line", F.transform("line", lambda p: F.struct((p["x"] * 5280).alias("x"), (p["y"] * 5280).alias("y")))
    )
    return rail.job_track_table(stretched, rail.job_crossing_table(crossings(spark, d)))


_DEVICES = {
    "FourQuad": "Four Quadrant Gates", "GatesWithMedian": "Gates with Medians", "Gates": "Gates",
    "FlashingOnly": "Flashing Lights Only", "StopSign": "Stop Sign", "Crossbuck": "Crossbuck", "Unknown": "Unknown",
}


@query("job_warning_table", f"""
WITH {XINGS} SELECT rr AS "Railroad", {', '.join(f"""count(*) FILTER (dev = '{k}') AS "{v}" """ for k, v in _DEVICES.items())},
  count(*) AS "Total" FROM xing WHERE kind IN ('PubHwy', 'PubPed') GROUP BY 1
""")
def job_warning_table(spark, d):
    return rail.job_warning_table(crossings(spark, d))


def crashes(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("GXID"),
        F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0").alias("YEAR"),
        F.when(F.col("l_quantity") > 45, "1").when(F.col("l_quantity") > 43, "unknown").otherwise("0").alias("TOTKLD"),
        F.when(F.col("l_quantity") > 30, "2").otherwise("0").alias("TOTINJ"),
    )


@query("job_crash_severity", f"""
WITH {XINGS}, c AS (SELECT l_orderkey AS k, CASE WHEN l_partkey % 100 <= 23 THEN 2000 ELSE 1900 END + l_partkey % 100 AS y,
  CASE WHEN l_quantity > 45 THEN 'Fatal' WHEN l_quantity > 30 THEN 'Injury' ELSE 'PDO' END AS sev FROM lineitem),
n AS (SELECT k, count(*) FILTER (sev = 'Fatal') AS "Fatal", count(*) FILTER (sev = 'Injury') AS "Injury",
  count(*) FILTER (sev = 'PDO') AS "PDO", count(*) AS "TotalCrashes" FROM c WHERE y >= 2016 GROUP BY 1)
SELECT CAST(k AS VARCHAR) AS "CrossingID", kind AS "Type", n.* EXCLUDE (k) FROM n JOIN xing USING (k)
""")
def job_crash_severity(spark, d):
    return rail.job_crash_severity(crashes(spark, d), crossings(spark, d), keep=("Type",))


# ---- carriers ------------------------------------------------------------------------------------------


def census(spark, d):
    """One carrier per order."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.join(c, cust == F.col("c_custkey")).select(
        k.alias("DOT"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("PHY_STATE"),
        F.concat(F.lit("N"), F.when(k % 5 == 0, k % 25).otherwise(F.col("c_nationkey")).cast("string")).alias("MAILING_STATE"),
        F.concat(F.lpad(cust.cast("string"), 5, "0"), F.lit("-1234")).alias("PHY_ZIP"),
        F.concat(F.lit("01-JAN-"), F.right(F.year("o_orderdate").cast("string"), F.lit(2))).alias("MCS150_DATE"),
        F.when(F.col("o_orderstatus") == "P", "Y").otherwise("N").alias("PC_FLAG"),
        F.when(k % 13 == 0, "Y").otherwise("N").alias("PRIVATE_PASSENGER_BUSINESS"),
        F.when(k % 17 == 0, "Y").otherwise("N").alias("PRIVATE_PASSENGER_NONBUSINESS"),
        F.when(k % 19 != 0, (k % 40).cast("int")).alias("NBR_POWER_UNIT"),
        (cust % 60).cast("int").alias("DRIVER_TOTAL"),
        F.when(k % 7 != 0, (k * 10).cast("bigint")).alias("MCS150_MILEAGE"),
    )


STATES = ("N0", "N1", "N2", "N3", "N4", "N5", "N6", "N7")
CENSUS = f"""
cen AS (SELECT o_orderkey AS k, 'N' || c_nationkey AS ps, 'N' || CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 25 ELSE c_nationkey END AS ms,
  lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS zip, year(o_orderdate) AS y, o_orderstatus,
  CASE WHEN o_orderkey % 19 <> 0 THEN o_orderkey % 40 END AS tr, o_custkey % 60 AS dr, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey * 10 END AS mi
  FROM orders JOIN customer ON o_custkey = c_custkey),
scr AS (SELECT * FROM cen WHERE ps IN {STATES} AND o_orderstatus <> 'P' AND k % 13 <> 0 AND k % 17 <> 0 AND y BETWEEN 1996 AND 1999
  AND tr > 0 AND dr > 0 AND dr < 10 * tr AND tr < 10 * dr)"""


def screened(spark, d):
    return carriers.screen_carriers(census(spark, d), STATES, 96, 99)


@query("job_carriers", f"""
WITH {CENSUS} SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS "ZCTA5CE10", trucks, mileage FROM customer LEFT JOIN (
  SELECT zip, CAST(sum(tr) AS BIGINT) AS trucks, CAST(coalesce(sum(mi), 0) AS BIGINT) AS mileage FROM scr GROUP BY 1)
ON zip = lpad(CAST(c_custkey AS VARCHAR), 5, '0')
""")
def job_carriers(spark, d):
    zips = table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("ZCTA5CE10"))
    return carriers.job_carriers(screened(spark, d), zips)


@query("job_carriers_by_state", f"""
WITH {CENSUS} SELECT ps AS "PHY_STATE", count(*) AS n, ps || ' (' || count(*) || ')' AS label, CAST(sum(tr) AS BIGINT) AS trucks FROM scr GROUP BY 1
""")
def job_carriers_by_state(spark, d):
    return carriers.carriers_by_state(screened(spark, d))


@query("job_carrier_mismatch", f"""WITH {CENSUS} SELECT k AS "DOT", ps AS "PHY_STATE", ms AS "MAILING_STATE" FROM cen WHERE ps <> ms AND (ps = 'N1' OR ms = 'N1')""")
def job_carrier_mismatch(spark, d):
    return carriers.address_mismatch(census(spark, d), "N1").select("DOT", "PHY_STATE", "MAILING_STATE")


@query("job_carbon_density", """
WITH kept AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS f, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value - 100 END AS x
  FROM events WHERE event_id % 10 = 0 OR event_type NOT IN ('error', 'view')),
ord AS (SELECT f, count(*) AS n, coalesce(f, 'NA') || ' (' || count(*) || ')' AS chart_name,
  row_number() OVER (ORDER BY count(*) DESC, f NULLS FIRST) AS chart_order FROM kept GROUP BY 1),
inr AS (SELECT f, x FROM kept WHERE x BETWEEN -400 AND 200),
bw AS (SELECT f, count(*) AS nn, 0.9 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * power(count(*), -0.2) AS h
  FROM inr GROUP BY 1),
pos AS (SELECT f, (x + 400) / (600.0 / 256) AS p, least(floor((x + 400) / (600.0 / 256)), 255) AS l FROM inr),
nodes AS (SELECT f, i, sum(w) AS w FROM (SELECT f, l AS i, 1 - (p - l) AS w FROM pos UNION ALL SELECT f, l + 1, p - l FROM pos) GROUP BY 1, 2)
SELECT ord.f AS fuel_category, chart_name, chart_order, n, round(-400 + g.g * (600.0 / 63), 4) AS x,
  round(sum(w * exp(-0.5 * power((g.g * (600.0 / 63) - i * (600.0 / 256)) / h, 2))) / (max(nn) * max(h) * sqrt(2 * pi())), 6) AS density
FROM nodes JOIN bw ON nodes.f IS NOT DISTINCT FROM bw.f JOIN ord ON ord.f IS NOT DISTINCT FROM bw.f, range(64) g(g) GROUP BY ALL
""")
def job_carbon_density(spark, d):
    k = F.col("event_id")
    raw = table(spark, d, "events").select(
        F.when(k % 10 != 0, F.col("event_type")).alias("Fuel Category"),
        F.when(k % 11 == 0, "n/a").otherwise((F.col("value") - 100).cast("string")).alias("Current Certified CI"),
    )
    out = carriers.job_carbon_density(raw, n=64, bins=256, leave_out=("error", "view"))
    return rounded(rounded(out, 4, "x"), 6, "density")
