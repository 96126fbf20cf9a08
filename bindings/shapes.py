"""Points, lines and areas derived from customer, supplier and nation, and the same as SQL."""

from pyspark.sql import functions as F

from .registry import table


def _xy(k):
    return F.struct(((k * 37) % 1000).cast("double").alias("x"), ((k * 91) % 1000).cast("double").alias("y"))


def points(spark, d):
    """One point per customer."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), _xy(F.col("c_custkey")).alias("p")).select(
        "id", "p.x", "p.y"
    )


def lines(spark, d, *extra):
    """One three-vertex line per supplier; neighbours share a piece."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("line_id"), *extra, F.array(_xy(k), _xy(k + 1), _xy(k + 2)).alias("line")
    )


OUTER = [(0, 0), (200, 0), (200, 100), (100, 100), (100, 200), (0, 200), (0, 0)]
HOLE = [(30, 30), (30, 70), (70, 70), (70, 30), (30, 30)]
NOTCH = [(110, 110), (190, 110), (190, 190), (110, 190), (110, 110)]
SQUARE = [(0, 0), (200, 0), (200, 200), (0, 200), (0, 0)]


def _areas(spark, d, rings):
    k = F.col("n_nationkey")
    x0, y0 = (k % 5) * 200 + 300.5, F.floor(k / 5) * 200 + 0.5
    ring = [
        F.array(*[F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in r]) for r in rings
    ]
    return table(spark, d, "nation").select(k.alias("area"), "n_name", F.array(*ring).alias("rings"))


def areas(spark, d):
    """One L-shape with a hole per nation; the last column of areas lies beyond all points."""
    return _areas(spark, d, [OUTER, HOLE])


def two_part_areas(spark, d):
    """The L-shape with its hole, and a square in its notch, as one area of two parts."""
    whole = _areas(spark, d, [OUTER, HOLE, NOTCH])
    return whole.select("area", F.array(F.slice("rings", 1, 2), F.slice("rings", 3, 1)).alias("polygons"))


def tiles(spark, d):
    return _areas(spark, d, [SQUARE])


def _values(rings):
    return ", ".join(f"({r}, {i}, {x}, {y})" for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring))


def _edges_sql(name, rings):
    return f"""
{name}_ring AS (SELECT n_nationkey AS area, o.r, o.i, CAST(n_nationkey % 5 * 200 + 300.5 + o.dx AS DOUBLE) AS x,
  CAST(n_nationkey // 5 * 200 + 0.5 + o.dy AS DOUBLE) AS y FROM nation, (VALUES {_values(rings)}) o(r, i, dx, dy)),
{name} AS (SELECT a.area, a.r, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM {name}_ring a JOIN {name}_ring b ON a.area = b.area AND a.r = b.r AND b.i = a.i + 1)"""


PTS = """
pts AS (SELECT c_custkey AS id, CAST((c_custkey * 37) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 91) % 1000 AS DOUBLE) AS y
  FROM customer)"""
SEGS = """
vert AS (SELECT s_suppkey AS line_id, s_acctbal, r.i AS vertex, CAST(((s_suppkey + r.i) * 37) % 1000 AS DOUBLE) AS x,
  CAST(((s_suppkey + r.i) * 91) % 1000 AS DOUBLE) AS y FROM supplier, range(3) r(i)),
segs AS (SELECT a.line_id, a.s_acctbal, a.vertex AS seg, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2,
    sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len
  FROM vert a JOIN vert b ON a.line_id = b.line_id AND b.vertex = a.vertex + 1)"""
EDGES = _edges_sql("edges", [OUTER, HOLE])
TWO_PART_EDGES = _edges_sql("two_part", [OUTER, HOLE, NOTCH])
TILE_EDGES = _edges_sql("tile_edges", [SQUARE])


def hit_sql(name, source, key, x="x", y="y"):
    """CTE: (area, key) pairs of points inside, by ray casting over all edges."""
    return f"""
{name} AS (SELECT area, {key} FROM {source} JOIN edges ON (y1 <= {y}) <> (y2 <= {y})
  AND x1 + ({y} - y1) * (x2 - x1) / (y2 - y1) < {x} GROUP BY area, {key} HAVING count(*) % 2 = 1)"""


def dist_sql(px, py, s=""):
    """Distance from a point to segment ``s``."""
    x1, y1, x2, y2 = (s + c for c in ("x1", "y1", "x2", "y2"))
    t = (
        f"greatest(0, least(1, coalesce((({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / "
        f"nullif(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}), 0), 0)))"
    )
    dx, dy = f"({px} - ({x1} + {t} * ({x2} - {x1})))", f"({py} - ({y1} + {t} * ({y2} - {y1})))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def within_sql(name, d):
    """CTEs: line_id of lines within ``d`` of the pieces ``net``; a line that leaves them does so just behind a root."""
    return f"""
pairs AS (SELECT s.line_id, s.seg, s.x1, s.y1, s.x2, s.y2, n.x1 AS nx1, n.y1 AS ny1, n.x2 AS nx2, n.y2 AS ny2,
  (s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1) AS a FROM segs s, net n),
discs AS (SELECT *, (x1 - nx1) * (x2 - x1) + (y1 - ny1) * (y2 - y1) AS b1, (x1 - nx1) * (x1 - nx1) + (y1 - ny1) * (y1 - ny1) - {d} * {d} AS c1,
  (x1 - nx2) * (x2 - x1) + (y1 - ny2) * (y2 - y1) AS b2, (x1 - nx2) * (x1 - nx2) + (y1 - ny2) * (y1 - ny2) - {d} * {d} AS c2,
  sqrt((nx2 - nx1) * (nx2 - nx1) + (ny2 - ny1) * (ny2 - ny1)) * {d} AS side,
  (x1 - nx1) * (ny2 - ny1) - (y1 - ny1) * (nx2 - nx1) AS h0, (x2 - x1) * (ny2 - ny1) - (y2 - y1) * (nx2 - nx1) AS h1 FROM pairs),
roots AS (SELECT *, unnest([CASE WHEN b1 * b1 >= a * c1 THEN (-b1 + sqrt(b1 * b1 - a * c1)) / a END,
  CASE WHEN b2 * b2 >= a * c2 THEN (-b2 + sqrt(b2 * b2 - a * c2)) / a END,
  (side - h0) / nullif(h1, 0), (-side - h0) / nullif(h1, 0)]) AS t FROM discs),
stops AS (SELECT line_id, seg, 0.0 AS t FROM segs UNION SELECT line_id, seg, t + 1e-7 FROM (
    SELECT *, x1 + t * (x2 - x1) AS rx, y1 + t * (y2 - y1) AS ry FROM roots WHERE t >= 0 AND t < 1 - 1e-7)
  WHERE {dist_sql('rx', 'ry', 'n')} <= {d} + 1e-6),
seen AS (SELECT line_id, seg, t, x1 + t * (x2 - x1) AS x, y1 + t * (y2 - y1) AS y FROM stops JOIN segs USING (line_id, seg)),
tested AS (SELECT line_id, seg, t, min({dist_sql('seen.x', 'seen.y', 'net.')}) <= {d} + 1e-9 AS near FROM seen, net GROUP BY 1, 2, 3),
{name} AS (SELECT line_id FROM tested GROUP BY 1 HAVING bool_and(near))"""


def seg_dist_sql(a, b):
    """Distance between segments ``a`` and ``b``."""

    def turn(p, q, r):
        return f"(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"

    a1, a2, b1, b2 = (a + "x1", a + "y1"), (a + "x2", a + "y2"), (b + "x1", b + "y1"), (b + "x2", b + "y2")
    crossing = (
        f"{turn(b1, b2, a1)} * {turn(b1, b2, a2)} < 0 AND {turn(a1, a2, b1)} * {turn(a1, a2, b2)} < 0"
    )
    ends = f"least({dist_sql(*a1, b)}, {dist_sql(*a2, b)}, {dist_sql(*b1, a)}, {dist_sql(*b2, a)})"
    return f"CASE WHEN {crossing} THEN 0 ELSE {ends} END"
