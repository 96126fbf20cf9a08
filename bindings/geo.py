"""Geometry operators and spatial joins; the SQL twins are brute force over all pairs."""

from pyspark.sql import functions as F

from haulgrid.functions import geometry as G
from haulgrid.functions.geometry import EARTH_RADIUS, GRS80_A, US_FOOT, ZONE_6501
from haulgrid.operators import spatial as P

from .registry import query, table
from .shapes import (
    EDGES, PTS, SEGS, TILE_EDGES, areas, dist_sql, hit_sql, lines, points, seg_dist_sql, tiles, within_sql,
)

CELL = 100.0


@query("geo_point", """
SELECT c_custkey AS id, CAST((c_custkey * 37) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 91) % 1000 AS DOUBLE) AS y
FROM customer WHERE c_acctbal >= 0
""")
def geo_point(spark, d):
    k = F.col("c_custkey")
    lon = F.when(F.col("c_acctbal") >= 0, (k * 37) % 1000)
    located = table(spark, d, "customer").select(k.alias("id"), lon.alias("lon"), ((k * 91) % 1000).alias("lat"))
    return located.filter(F.col("lon").isNotNull()).select("id", G.point("lon", "lat").alias("p")).select("id", "p.x", "p.y")


_E, _N, _F, _RHO0 = G._cone(ZONE_6501)
LON, LAT = "(-97 + x * 0.007)", "(43.5 + y * 0.0055)"


@query("geo_project", f"""
WITH {PTS},
ll AS (SELECT id, {LON} AS lon, {LAT} AS lat, {_E!r} * sin(radians({LAT})) AS s FROM pts),
pol AS (SELECT *, {GRS80_A * _F!r} * power(tan(pi() / 4 - radians(lat) / 2) / power((1 - s) / (1 + s), {_E / 2!r}), {_N!r}) AS rho,
  {_N!r} * radians(lon - ({ZONE_6501['lon0']!r})) AS theta FROM ll)
SELECT id, round(({ZONE_6501['false_e']!r} + rho * sin(theta)) / {US_FOOT!r}, 2) AS east,
  round(({ZONE_6501['false_n']!r} + {_RHO0!r} - rho * cos(theta)) / {US_FOOT!r}, 2) AS north,
  round(lon, 7) AS lon_back, round(lat, 7) AS lat_back FROM pol
""")
def geo_project(spark, d):
    ll = points(spark, d).select(
        "id", F.struct((F.col("x") * 0.007 - 97).alias("x"), (F.col("y") * 0.0055 + 43.5).alias("y")).alias("p")
    )
    plane = ll.select("id", G.project("p", 4326, 6501, 0).alias("q"))
    back = plane.select("id", "q", G.project("q", 6501, 4326, 0).alias("b"))
    return back.select(
        "id", F.round("q.x", 2).alias("east"), F.round("q.y", 2).alias("north"),
        F.round("b.x", 7).alias("lon_back"), F.round("b.y", 7).alias("lat_back"),
    )


_HAV = (
    "power(sin(radians(0.0055 * (y2 - y1)) / 2), 2) + cos(radians(43.5 + 0.0055 * y1)) * cos(radians(43.5 + 0.0055 * y2))"
    " * power(sin(radians(0.007 * (x2 - x1)) / 2), 2)"
)


@query("geo_length", f"""
WITH {SEGS} SELECT line_id, round(sum(len), 6) AS planar, round(sum(2 * {EARTH_RADIUS!r} * asin(sqrt({_HAV}))), 3) AS metres
FROM segs GROUP BY 1
""")
def geo_length(spark, d):
    ll = F.transform("line", lambda p: F.struct((p["x"] * 0.007 - 97).alias("x"), (p["y"] * 0.0055 + 43.5).alias("y")))
    return lines(spark, d).select(
        "line_id", F.round(G.length("line"), 6).alias("planar"), F.round(G.length(ll, geodesic=True), 3).alias("metres")
    )


@query("geo_area", f"""
WITH {EDGES}, a AS (SELECT area, r, abs(sum(x1 * y2 - x2 * y1)) / 2 AS s FROM edges GROUP BY 1, 2)
SELECT area, round(sum(CASE WHEN r = 0 THEN s ELSE -s END), 4) AS sqft FROM a GROUP BY 1
""")
def geo_area(spark, d):
    return areas(spark, d).select("area", F.round(G.area("rings"), 4).alias("sqft"))


@query("geo_vertices", f"WITH {SEGS} SELECT line_id, CAST(vertex AS INT) AS vertex, x, y FROM vert")
def geo_vertices(spark, d):
    return P.vertices(lines(spark, d), "line", ["line_id"])


@query("geo_drop_zm", f"WITH {SEGS} SELECT line_id, 2 AS n_dims, round(sum(x), 4) AS sx, round(sum(y), 4) AS sy FROM vert GROUP BY 1")
def geo_drop_zm(spark, d):
    solid = lines(spark, d).withColumn(
        "line", F.transform("line", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(7.0).alias("z")))
    )
    flat = solid.withColumn("line", G.force_2d("line"))
    dims = len(flat.schema["line"].dataType.elementType.fields)

    def total(axis):
        return F.aggregate("line", F.lit(0.0), lambda acc, p: acc + p[axis])

    return flat.select("line_id", F.lit(dims).alias("n_dims"), F.round(total("x"), 4).alias("sx"), F.round(total("y"), 4).alias("sy"))


@query("geo_point_on_surface", f"""
WITH {EDGES}, mid AS (SELECT area, (min(y1) + max(y1)) / 2 AS y FROM edges GROUP BY 1),
cross_x AS (SELECT area, y, x1 + (y - y1) * (x2 - x1) / (y2 - y1) AS x,
  row_number() OVER (PARTITION BY area ORDER BY x1 + (y - y1) * (x2 - x1) / (y2 - y1)) AS rn
  FROM edges JOIN mid USING (area) WHERE (y1 <= y) <> (y2 <= y)),
span AS (SELECT a.area, a.y, b.x - a.x AS w, (a.x + b.x) / 2 AS x
  FROM cross_x a JOIN cross_x b ON a.area = b.area AND a.rn % 2 = 1 AND b.rn = a.rn + 1)
SELECT area, round(x, 6) AS x, round(y, 6) AS y FROM (
  SELECT *, row_number() OVER (PARTITION BY area ORDER BY w DESC, x DESC) AS k FROM span) WHERE k = 1
""")
def geo_point_on_surface(spark, d):
    return areas(spark, d).select("area", G.point_on_surface("rings").alias("p")).select(
        "area", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y")
    )


@query("geo_bearing", f"""
WITH {SEGS}, e AS (SELECT line_id, radians(43.5 + 0.0055 * max(CASE WHEN vertex = 0 THEN y END)) AS a,
  radians(43.5 + 0.0055 * max(CASE WHEN vertex = 2 THEN y END)) AS b,
  radians(0.007 * (max(CASE WHEN vertex = 2 THEN x END) - max(CASE WHEN vertex = 0 THEN x END))) AS dl FROM vert GROUP BY 1)
SELECT line_id, round(degrees(atan2(sin(dl) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(dl))), 6) AS bearing FROM e
""")
def geo_bearing(spark, d):
    ll = F.transform("line", lambda p: F.struct((p["x"] * 0.007 - 97).alias("x"), (p["y"] * 0.0055 + 43.5).alias("y")))
    return lines(spark, d).select("line_id", F.round(G.bearing(ll), 6).alias("bearing"))


def parts_sql(step):
    """CTEs: lines cut into equal parts no longer than ``step``."""
    return f"""
cum AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY line_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d0,
  sum(len) OVER (PARTITION BY line_id) AS total FROM segs),
tot AS (SELECT line_id, any_value(total) AS total, CAST(greatest(1, ceil(any_value(total) / {step})) AS INT) AS n FROM cum GROUP BY 1),
cut AS (SELECT line_id, n, i, i * total / n AS s FROM tot, LATERAL (SELECT unnest(range(n + 1)) AS i)),
pos AS (SELECT line_id, n, i, x1 + least(1, (s - d0) / len) * (x2 - x1) AS x, y1 + least(1, (s - d0) / len) * (y2 - y1) AS y FROM (
  SELECT cut.*, x1, y1, x2, y2, len, d0, row_number() OVER (PARTITION BY cut.line_id, i ORDER BY d0 DESC) AS k
  FROM cut JOIN cum ON cut.line_id = cum.line_id AND d0 <= s + 1e-9 AND len > 0) WHERE k = 1)"""


@query("geo_split_lines", f"""
WITH {SEGS}, {parts_sql(50)}
SELECT a.line_id, CAST(a.i + 1 AS INT) AS part, a.n AS n_parts, round(a.x, 4) AS x0, round(a.y, 4) AS y0, round(b.x, 4) AS x1,
  round(b.y, 4) AS y1, round(total / a.n, 4) AS len
FROM pos a JOIN pos b ON a.line_id = b.line_id AND b.i = a.i + 1 JOIN tot ON tot.line_id = a.line_id
""")
def geo_split_lines(spark, d):
    parts = P.split_lines(lines(spark, d), "line", ["line_id"], 50.0)
    a, b = F.col("line")[0], F.element_at("line", -1)
    return parts.select(
        "line_id", "part", "n_parts", F.round(a["x"], 4).alias("x0"), F.round(a["y"], 4).alias("y0"),
        F.round(b["x"], 4).alias("x1"), F.round(b["y"], 4).alias("y1"), F.round(G.length("line"), 4).alias("len"),
    )


@query("geo_lines_within", f"""
WITH {SEGS}, net AS (SELECT x1, y1, x2, y2 FROM segs WHERE s_acctbal >= 5000), {within_sql('ok', 60)} SELECT line_id FROM ok
""")
def geo_lines_within(spark, d):
    all_lines = lines(spark, d, "s_acctbal")
    network = P.segments(all_lines.filter("s_acctbal >= 5000"), "line", [])
    return P.lines_within(all_lines, "line", "line_id", network, 60.0).select("line_id")


def _place_sql(x, y):
    return f"CASE WHEN abs(x2 - x1) >= abs(y2 - y1) THEN ({x} - x1) / nullif(x2 - x1, 0) ELSE ({y} - y1) / nullif(y2 - y1, 0) END"


CLIP = f"""
cutters AS (SELECT DISTINCT CASE WHEN back THEN x2 ELSE x1 END AS ex1, CASE WHEN back THEN y2 ELSE y1 END AS ey1,
  CASE WHEN back THEN x1 ELSE x2 END AS ex2, CASE WHEN back THEN y1 ELSE y2 END AS ey2
  FROM (SELECT *, x1 > x2 OR (x1 = x2 AND y1 > y2) AS back FROM edges)),
hits AS (SELECT line_id, seg, CASE WHEN d1 = 0 THEN {_place_sql('ex1', 'ey1')} WHEN d2 = 0 THEN {_place_sql('ex2', 'ey2')} ELSE s1 / (s1 - s2) END AS t FROM (
  SELECT *, (ex2 - ex1) * (y1 - ey1) - (ey2 - ey1) * (x1 - ex1) AS s1, (ex2 - ex1) * (y2 - ey1) - (ey2 - ey1) * (x2 - ex1) AS s2,
    (x2 - x1) * (ey1 - y1) - (y2 - y1) * (ex1 - x1) AS d1, (x2 - x1) * (ey2 - y1) - (y2 - y1) * (ex2 - x1) AS d2
  FROM segs, cutters) WHERE (s1 > 0) <> (s2 > 0) AND d1 * d2 <= 0),
stops AS (SELECT line_id, seg, t FROM hits UNION SELECT line_id, seg, 0.0 FROM segs UNION SELECT line_id, seg, 1.0 FROM segs),
spans AS (SELECT *, lead(t) OVER (PARTITION BY line_id, seg ORDER BY t) AS t1 FROM stops),
parts AS (SELECT line_id, seg, t, t1, len * (t1 - t) AS part_len, sx1 + (t + t1) / 2 * (sx2 - sx1) AS x, sy1 + (t + t1) / 2 * (sy2 - sy1) AS y
  FROM spans JOIN (SELECT line_id, seg, len, x1 AS sx1, y1 AS sy1, x2 AS sx2, y2 AS sy2 FROM segs) USING (line_id, seg)
  WHERE t1 > t)"""


@query("geo_clip_lines", f"""
WITH {SEGS}, {EDGES}, {CLIP}, {hit_sql('hit', 'parts', 'line_id, seg, t, part_len')}
SELECT line_id, area, round(sum(part_len), 4) AS inside_len FROM hit GROUP BY 1, 2
""")
def geo_clip_lines(spark, d):
    clipped = P.clip_lines(lines(spark, d), "line", "line_id", areas(spark, d).drop("n_name"), "rings", "area", CELL)
    total = F.aggregate(F.transform("lines", lambda part: G.length(part)), F.lit(0.0), lambda a, b: a + b)
    return clipped.select("line_id", "area", F.round(total, 4).alias("inside_len"))


@query("geo_clip_runs", f"""
WITH {SEGS}, {EDGES}, {CLIP}, {hit_sql('hit', 'parts', 'line_id, seg, t, t1')},
steps AS (SELECT *, lag(seg) OVER w AS s0, lag(t1) OVER w AS t0 FROM hit WINDOW w AS (PARTITION BY line_id, area ORDER BY seg, t)),
runs AS (SELECT *, sum(CASE WHEN (seg = s0 AND t = t0) OR (seg = s0 + 1 AND t = 0 AND t0 = 1) THEN 0 ELSE 1 END)
  OVER (PARTITION BY line_id, area ORDER BY seg, t) AS run FROM steps),
ends AS (SELECT line_id, area, CAST(run AS INTEGER) AS run, min(seg + t) AS a, max(seg + t1) AS b, min(seg) AS s, max(seg) AS e,
  arg_min(t, seg + t) AS ta, arg_max(t1, seg + t1) AS tb FROM runs GROUP BY 1, 2, 3)
SELECT ends.line_id, area, run, round(f.x1 + ta * (f.x2 - f.x1), 4) AS x0, round(f.y1 + ta * (f.y2 - f.y1), 4) AS y0,
  round(g.x1 + tb * (g.x2 - g.x1), 4) AS x1, round(g.y1 + tb * (g.y2 - g.y1), 4) AS y1
FROM ends JOIN segs f ON f.line_id = ends.line_id AND f.seg = s JOIN segs g ON g.line_id = ends.line_id AND g.seg = e
""")
def geo_clip_runs(spark, d):
    """Every stretch of a line inside an area with its two ends."""
    clipped = P.clip_lines(lines(spark, d), "line", "line_id", areas(spark, d).drop("n_name"), "rings", "area", CELL)
    runs = clipped.select("line_id", "area", F.posexplode("lines").alias("run", "part"))
    a, b = F.col("part")[0], F.element_at("part", -1)
    return runs.select(
        "line_id", "area", (F.col("run") + 1).alias("run"), F.round(a["x"], 4).alias("x0"), F.round(a["y"], 4).alias("y0"),
        F.round(b["x"], 4).alias("x1"), F.round(b["y"], 4).alias("y1"),
    )


@query("geo_dissolve_edges", f"""
WITH {TILE_EDGES}, n AS (SELECT CASE WHEN x1 > x2 OR (x1 = x2 AND y1 > y2) THEN [x2, y2, x1, y1] ELSE [x1, y1, x2, y2] END AS e FROM tile_edges)
SELECT e[1] AS x1, e[2] AS y1, e[3] AS x2, e[4] AS y2 FROM n GROUP BY e HAVING count(*) = 1
""")
def geo_dissolve_edges(spark, d):
    return P.dissolve_edges(tiles(spark, d), "rings")


_RING = "CAST(((s_suppkey + {0}) * {1}) % 1000 AS DOUBLE)"
_QUAD = ", ".join(f"{_RING.format(i, 37)} AS x{i}, {_RING.format(i, 91)} AS y{i}" for i in range(4))


def _turn(a, b, c):
    return f"((x{b} - x{a}) * (y{c} - y{a}) - (y{b} - y{a}) * (x{c} - x{a}))"


def _cross(a, b, c, e):
    return (
        f"CASE WHEN {_turn(c, e, a)} * {_turn(c, e, b)} < 0 AND {_turn(a, b, c)} * {_turn(a, b, e)} < 0 THEN 1 ELSE 0 END"
    )


@query("geo_validity", f"""
WITH q AS (SELECT s_suppkey AS id, {_QUAD} FROM supplier),
v AS (SELECT id, abs((x0 - x2) * (y1 - y3) - (x1 - x3) * (y0 - y2)) / 2 > 0 AS rings_sound,
  CAST({_cross(0, 1, 2, 3)} + {_cross(1, 2, 3, 0)} AS BIGINT) AS self_crossings FROM q)
SELECT id, rings_sound, self_crossings, rings_sound AND self_crossings = 0 AS valid FROM v
""")
def geo_validity(spark, d):
    k = F.col("s_suppkey")
    ring = F.array(*[
        F.struct((((k + i) * 37) % 1000).cast("double").alias("x"), (((k + i) * 91) % 1000).cast("double").alias("y"))
        for i in (0, 1, 2, 3, 0)
    ])
    quads = table(spark, d, "supplier").select(k.alias("id"), F.array(ring).alias("rings"))
    return P.validity(quads, "rings", "id")


@query("geo_drop_rename", "SELECT n_nationkey AS area, n_name, 7 AS n_points FROM nation")
def geo_drop_rename(spark, d):
    renamed = areas(spark, d).withColumnRenamed("rings", "geometry")
    return renamed.withColumn("n_points", F.size(F.col("geometry")[0])).drop("geometry")


@query("geo_expanded_extent", f"""
WITH {SEGS} SELECT min(x) - 5280 AS xmin, min(y) - 5280 AS ymin, max(x) + 5280 AS xmax, max(y) + 5280 AS ymax FROM vert
""")
def geo_expanded_extent(spark, d):
    return P.expanded_extent(lines(spark, d), "line", 5280.0)


# ---- spatial joins -------------------------------------------------------------------------------------


@query("sjoin_contains", f"""
WITH {PTS}, {EDGES}, {hit_sql('hit', 'pts', 'id, x, y')}
SELECT n_nationkey AS area, n_name, id, x, y FROM nation LEFT JOIN hit ON n_nationkey = area
""")
def sjoin_contains(spark, d):
    return P.spatial_join(areas(spark, d), points(spark, d), "rings", "area", CELL)


@query("sjoin_points_in_area", f"""
WITH {PTS}, {EDGES}, {hit_sql('hit', 'pts', 'id')}
SELECT id, area, n_name FROM hit JOIN nation ON n_nationkey = area
""")
def sjoin_points_in_area(spark, d):
    return P.points_in_area(points(spark, d), areas(spark, d), "rings").select("id", "area", "n_name")


@query("sjoin_within_distance", f"""
WITH {PTS}, {SEGS}
SELECT DISTINCT id, x, y FROM pts, segs WHERE {dist_sql('x', 'y')} <= 5
""")
def sjoin_within_distance(spark, d):
    return P.within_distance(points(spark, d), P.segments(lines(spark, d), "line", []), 5.0)


@query("sjoin_nearest", f"""
WITH {PTS}, {SEGS}, dd AS (SELECT id, line_id, min({dist_sql('x', 'y')}) AS dist FROM pts, segs GROUP BY 1, 2)
SELECT id, line_id, round(dist, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, line_id) AS k FROM dd) WHERE k = 1
""")
def sjoin_nearest(spark, d):
    right = P.segments(lines(spark, d), "line", ["line_id"])
    out = P.nearest_join(P.point_segments(points(spark, d), ["id"]), right, ["id"], "line_id")
    return out.withColumn("distance", F.round("distance", 6))


@query("sjoin_nearest_lines", f"""
WITH {SEGS}, dd AS (SELECT a.line_id, b.line_id AS near_id, min({seg_dist_sql('a.', 'b.')}) AS dist
  FROM segs a, segs b WHERE a.s_acctbal < 5000 AND b.s_acctbal >= 5000 GROUP BY 1, 2)
SELECT line_id, near_id, round(dist, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY dist, near_id) AS k FROM dd) WHERE k = 1
""")
def sjoin_nearest_lines(spark, d):
    segs = P.segments(lines(spark, d, "s_acctbal"), "line", ["line_id", "s_acctbal"])
    unknown = segs.filter("s_acctbal < 5000").drop("s_acctbal")
    known = segs.filter("s_acctbal >= 5000").drop("s_acctbal").withColumnRenamed("line_id", "near_id")
    out = P.nearest_join(unknown, known, ["line_id"], "near_id")
    return out.withColumn("distance", F.round("distance", 6))
