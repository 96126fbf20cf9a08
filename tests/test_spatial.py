"""Geometry and spatial joins: properties and brute force, evenly spread and crowded."""

import math
import random

import pytest
from pyspark.sql import functions as F

from haulgrid.functions import geometry as G
from haulgrid.operators import spatial as P

LINE = "line array<struct<x:double,y:double>>"
RINGS = "rings array<array<struct<x:double,y:double>>>"


def segment_distance(px, py, s):
    x1, y1, x2, y2 = s
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = 0 if n == 0 else max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / n))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def inside(px, py, rings):
    hits = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 <= py) != (y2 <= py) and x1 + (py - y1) * (x2 - x1) / (y2 - y1) < px:
                hits += 1
    return hits % 2 == 1


def star(cx, cy, r, n, rng):
    pts = [
        (cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n))
        for i in range(n)
    ]
    return pts + pts[:1]


def test_contains_matches_ray_casting(spark):
    rng = random.Random(3)
    polys = [(i, [star(rng.uniform(0, 100), rng.uniform(0, 100), 30, 25, rng)]) for i in range(6)]
    # integer corners and points, so that edges and vertices lie on cell borders and on points' lines
    square = [(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0), (0.0, 0.0)]
    polys.append((6, [square, [(10 + x / 4, 10 + y / 4) for x, y in square]]))
    pts = [(i, rng.uniform(-10, 110), rng.uniform(-10, 110)) for i in range(400)]
    pts += [(400 + i, float(i % 12 * 5), float(i // 12 * 5)) for i in range(120)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    areas = spark.createDataFrame(polys, f"area int, {RINGS}")
    for cell in (7.0, 10.0, 500.0, None):
        got = {(r["id"], r["area"]) for r in P.points_in_area(df, areas, "rings", cell).collect()}
        assert got == {(i, a) for i, x, y in pts for a, rings in polys if inside(x, y, rings)}


def test_spatial_join_keeps_empty_areas(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    far = [(x + 50, y) for x, y in square]
    areas = spark.createDataFrame([(1, [square]), (2, [far]), (3, [square])], f"area int, {RINGS}")
    pts = spark.createDataFrame([(9, 0.5, 0.5), (8, None, 0.5)], "id int, x double, y double")
    got = sorted(((r["area"], r["id"]) for r in P.spatial_join(areas, pts, "rings", "area", 1.0).collect()), key=str)
    assert got == [(1, 9), (2, None), (3, 9)]


@pytest.mark.parametrize("spread", ["even", "crowded"])
def test_nearest_matches_brute_force(spark, spread):
    rng = random.Random(5)

    def place():
        if spread == "crowded" and rng.random() < 0.6:
            return 500 + rng.gauss(0, 0.5), 500 + rng.gauss(0, 0.5)
        return rng.uniform(0, 1000), rng.uniform(0, 1000)

    segs = []
    for i in range(300):
        x, y = place()
        segs.append((i % 250, i, x, y, x + rng.uniform(-5, 5), y + rng.uniform(-5, 5)))
    pts = [(i, *place()) for i in range(200)] + [(200, -5000.0, 9000.0)]
    right = spark.createDataFrame(segs, "rid int, seg int, x1 double, y1 double, x2 double, y2 double")
    left = P.point_segments(spark.createDataFrame(pts, "id int, x double, y double"), ["id"])
    got = {r["id"]: (r["rid"], r["distance"]) for r in P.nearest_join(left, right, ["id"], "rid").collect()}
    assert len(got) == len(pts)
    for i, x, y in pts:
        best = min((segment_distance(x, y, s[2:]), s[0]) for s in segs)
        assert got[i][1] == pytest.approx(best[0], abs=1e-9)


def test_nearest_ties_and_empty_right(spark):
    right = spark.createDataFrame([(7, 0, 0.0, 1.0, 1.0, 1.0), (3, 0, 0.0, 1.0, 1.0, 1.0)], "rid int, seg int, x1 double, y1 double, x2 double, y2 double")
    left = P.point_segments(spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double"), ["id"])
    assert tuple(P.nearest_join(left, right, ["id"], "rid").first()) == (1, 3, 1.0)
    assert tuple(P.nearest_join(left, right.filter("rid > 9"), ["id"], "rid").first()) == (1, None, None)


def test_nearest_with_one_full_leaf_and_far_points(spark):
    """Most of the right side lies in one spot that no cell divides; left points lie in it, beside it and far outside."""
    rnd = random.Random(4)
    net = [(i, 5e5 + rnd.random() * 1e-4, 5e5 + rnd.random() * 1e-4) for i in range(1500)]
    net += [(1500 + i, rnd.uniform(0, 1e6), rnd.uniform(0, 1e6)) for i in range(40)]
    asked = [(0, 5e5, 5e5), (1, 4.9e5, 5.2e5), (2, -3e7, 4e5), (3, 9e6, 8e6), (4, 5e5 + 1e-4, 0.0), (5, None, 1.0)]
    asked += [(6 + i, rnd.uniform(-1e5, 1.2e6), rnd.uniform(-1e5, 1.2e6)) for i in range(20)]
    left = P.point_segments(spark.createDataFrame(asked, "id int, x double, y double"), ["id"])
    right = P.point_segments(spark.createDataFrame(net, "rid int, x double, y double"), ["rid"])
    got = {r["id"]: (r["rid"], r["distance"]) for r in P.nearest_join(left, right, ["id"], "rid").collect()}
    assert got.pop(5) == (None, None)
    for i, x, y in asked:
        if i != 5:
            d = min(math.hypot(x - u, y - v) for _, u, v in net)
            assert got[i][1] == pytest.approx(d, rel=1e-9, abs=1e-9)


def test_within_and_beyond_split_the_points(spark):
    rng = random.Random(9)
    pts = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(300)]
    segs = [(rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(6)]
    segs.append((50.0, 0.0, 50.0, 100.0))
    df = spark.createDataFrame(pts, "id int, x double, y double")
    net = spark.createDataFrame(segs, "x1 double, y1 double, x2 double, y2 double")
    near = {r["id"] for r in P.within_distance(df, net, 4.0).collect()}
    assert near == {i for i, x, y in pts if min(segment_distance(x, y, s) for s in segs) <= 4.0}
    assert {r["id"] for r in P.beyond_distance(df, net, 4.0, cell=3.0).collect()} == {p[0] for p in pts} - near


def test_split_keeps_length_and_limit(spark):
    lines = [(1, [(0, 0), (1320, 0)]), (2, [(0, 0), (1000, 0), (1000, 2000)]), (3, [(0, 0), (0, 0), (100, 0)])]
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in l]) for i, l in lines], f"id int, {LINE}")
    parts = P.split_lines(df, "line", ["id"], 1320.0).withColumn("len", G.length("line")).toPandas()
    assert parts.groupby("id")["part"].count().to_dict() == {1: 1, 2: 3, 3: 1}
    assert parts.groupby("id")["len"].sum().to_dict() == pytest.approx({1: 1320, 2: 3000, 3: 100})
    assert parts["len"].max() <= 1320 + 1e-6


def test_clip_leaves_and_reenters(spark):
    u = [(0, 0), (30, 0), (30, 10), (20, 10), (20, 5), (10, 5), (10, 10), (0, 10), (0, 0)]
    areas = spark.createDataFrame([(1, [[(float(x), float(y)) for x, y in u]])], f"area int, {RINGS}")
    df = spark.createDataFrame([(5, [(-5.0, 8.0), (35.0, 8.0)]), (6, [(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)])], f"id int, {LINE}")
    got = {r["id"]: [[(p["x"], p["y"]) for p in l] for l in r["lines"]] for r in P.clip_lines(df, "line", "id", areas, "rings", "area", 5.0).collect()}
    assert got == {5: [[(0, 8), (10, 8)], [(20, 8), (30, 8)]], 6: [[(1, 1), (2, 1), (3, 1)]]}


def test_dissolve_of_a_tiling_is_its_outer_box(spark):
    tiles = [(i, [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]]) for i, (x, y) in enumerate((float(a), float(b)) for a in range(3) for b in range(3))]
    out = P.dissolve_edges(spark.createDataFrame(tiles, f"id int, {RINGS}"), "rings").collect()
    assert len(out) == 12
    assert all(r["x1"] == r["x2"] and r["x1"] in (0, 3) or r["y1"] == r["y2"] and r["y1"] in (0, 3) for r in out)


def test_validity_report(spark):
    shapes = {
        1: [(0, 0), (1, 0), (1, 1), (0, 0)],
        2: [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)],
        3: [(0, 0), (1, 0), (1, 1)],
        4: [(0, 0), (1, 0), (2, 0), (0, 0)],
        5: [(0, 0), (1, float("nan")), (1, 1), (0, 0)],
    }
    df = spark.createDataFrame([(k, [[(float(x), float(y)) for x, y in v]]) for k, v in shapes.items()], f"id int, {RINGS}")
    got = {r["id"]: (r["rings_sound"], r["self_crossings"], r["valid"]) for r in P.validity(df, "rings", "id").collect()}
    assert got[1] == (True, 0, True)
    assert got[2][1] == 1 and not got[2][2]
    assert not got[3][2] and not got[4][2] and not got[5][2]


def test_crossings_between_long_and_short_edges(spark):
    rng = random.Random(2)
    shapes = {1: star(0, 0, 10, 30, rng)}
    for k in range(2, 7):
        shapes[k] = [(rng.uniform(0, 1) ** 6 * 100, rng.uniform(0, 1) ** 6 * 100) for _ in range(40)]
        shapes[k].append(shapes[k][0])

    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def crossings(ring):
        e = list(zip(ring, ring[1:]))
        return sum(
            turn(*e[j], e[i][0]) * turn(*e[j], e[i][1]) < 0 and turn(*e[i], e[j][0]) * turn(*e[i], e[j][1]) < 0
            for i in range(len(e)) for j in range(i)
        )

    df = spark.createDataFrame([(k, [v]) for k, v in shapes.items()], f"id int, {RINGS}")
    got = {r["id"]: r["self_crossings"] for r in P.validity(df, "rings", "id").collect()}
    assert got == {k: crossings(v) for k, v in shapes.items()}


def test_point_on_surface_is_inside(spark):
    rng = random.Random(11)
    polys = [(i, [star(0, 0, 10, 40, rng)]) for i in range(20)]
    df = spark.createDataFrame(polys, f"id int, {RINGS}").select("id", "rings", G.point_on_surface("rings").alias("p"))
    for r in df.collect():
        assert inside(r["p"]["x"], r["p"]["y"], [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]])


def test_projection_round_trip_origin_and_scale(spark):
    rows = [(-94.25, 45.0), (-97.2, 43.5), (-89.5, 49.3), (-93.0, 45.6166)]
    df = spark.createDataFrame(rows, "x double, y double").select(F.struct("x", "y").alias("p"))
    out = df.select("p", G.to_state_plane(F.col("p")).alias("q")).select("p", "q", G.to_lon_lat(F.col("q")).alias("b")).collect()
    for r in out:
        assert (r["b"]["x"], r["b"]["y"]) == pytest.approx((r["p"]["x"], r["p"]["y"]), abs=1e-9)
    assert out[0]["q"]["x"] == pytest.approx(800000 / G.US_FOOT)
    assert out[0]["q"]["y"] == pytest.approx(100000 / G.US_FOOT)

    # conformal: at any place the scale is the same to the north and to the east, and 1 on a standard parallel
    def scale(lon, lat, dlon, dlat):
        pair = spark.createDataFrame([(lon, lat), (lon + dlon, lat + dlat)], "x double, y double")
        a, b = [r[0] for r in pair.select(G.to_state_plane(F.struct("x", "y"))).collect()]
        e2 = G.GRS80_F * (2 - G.GRS80_F)
        s = 1 - e2 * math.sin(math.radians(lat)) ** 2
        north = G.GRS80_A * (1 - e2) / s**1.5 * math.radians(dlat)
        east = G.GRS80_A / math.sqrt(s) * math.cos(math.radians(lat)) * math.radians(dlon)
        return math.hypot(b["x"] - a["x"], b["y"] - a["y"]) * G.US_FOOT / math.hypot(north, east)

    lat = 45 + 37 / 60
    assert scale(-93.0, lat, 1e-5, 0) == pytest.approx(1, abs=1e-6)
    assert scale(-93.0, lat, 0, 1e-5) == pytest.approx(1, abs=1e-6)
    assert scale(-96.0, 48.5, 1e-5, 0) == pytest.approx(scale(-96.0, 48.5, 0, 1e-5), abs=1e-6)


def test_area_subtracts_holes_and_length_of_short_lines(spark):
    rings = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]]
    df = spark.createDataFrame([(rings, [(1.0, 1.0)])], f"{RINGS}, {LINE}")
    assert tuple(df.select(G.area("rings"), G.length("line"), G.multi_area(F.array("rings", "rings"))).first()) == (96.0, 0.0, 192.0)


def test_quarter_of_the_globe(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (90.0, 0.0)],)], LINE)
    row = df.select(G.length("line", geodesic=True).alias("m"), G.bearing("line").alias("b")).first()
    assert row["m"] == pytest.approx(math.pi / 2 * G.EARTH_RADIUS)
    assert row["b"] == pytest.approx(90)


def ring(*points):
    return [tuple(map(float, p)) for p in points]


TWO = [[ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))], [ring((5, 0), (8, 0), (8, 2), (5, 2), (5, 0)), ring((6, 1), (7, 1), (6, 1.5), (6, 1))]]
MANY = "polygons array<array<array<struct<x:double,y:double>>>>"


def test_areas_of_many_parts(spark):
    areas = spark.createDataFrame([(1, TWO)], f"id int, {MANY}")
    row = areas.select(G.whole_area(areas, "polygons").alias("a"), G.inner_point(areas, "polygons").alias("p")).first()
    assert row["a"] == pytest.approx(1 + 6 - 0.25) and 5 < row["p"]["x"] < 8 and 0 < row["p"]["y"] < 2
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 3.0, 0.5), (3, 5.5, 1.0), (4, 6.2, 1.1), (5, 7.5, 1.9)], "pid int, x double, y double")
    assert {r["pid"] for r in P.points_in_area(pts, areas, "polygons").collect()} == {1, 3, 5}
    line = spark.createDataFrame([(1, [(-1.0, 0.5), (9.0, 0.5)])], "line_id int, line array<struct<x:double,y:double>>")
    runs = P.clip_lines(line, "line", "line_id", areas, "polygons", "id").first()["lines"]
    assert [[p["x"] for p in run] for run in runs] == [[0.0, 1.0], [5.0, 8.0]]
    assert P.dissolve_edges(areas, "polygons").count() == 4 + 4 + 3
    assert P.validity(areas, "polygons", "id").first()["valid"]


def test_lines_of_many_parts(spark):
    parts = [[(0.0, 0.0), (0.0, 3.0)], [(10.0, 0.0), (10.0, 4.0), (13.0, 4.0)]]
    df = spark.createDataFrame([(1, parts)], "id int, line array<array<struct<x:double,y:double>>>")
    assert df.select(G.whole_length(df, "line")).first()[0] == 10.0
    assert P.segments(df, "line", ["id"]).count() == 3 and P.vertices(df, "line", ["id"]).select("vertex").distinct().count() == 5
    cut = P.split_lines(df, "line", ["id"], 2.0).collect()
    assert sorted((r["line_part"], r["part"], r["n_parts"]) for r in cut) == [(0, 1, 2), (0, 2, 2), (1, 1, 4), (1, 2, 4), (1, 3, 4), (1, 4, 4)]
    network = spark.createDataFrame([(0.0, 0.0, 0.0, 3.0)], "x1 double, y1 double, x2 double, y2 double")
    assert P.lines_within(df, "line", "id", network, 1.0).count() == 0


def test_lines_of_no_length(spark):
    rows = [(1, [(0.0, 0.0), (1.0, 0.0)]), (2, [(900.0, 0.0), (900.0, 0.0)]), (3, [(0.5, 0.0), (0.5, 0.0)]), (4, [(0.2, 0.1)]), (5, []), (6, None), (7, [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0)])]
    df = spark.createDataFrame(rows, "id int, line array<struct<x:double,y:double>>")
    assert sorted((r["id"], r["n_parts"]) for r in P.split_lines(df, "line", ["id"], 5.0).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 1)]
    network = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    assert sorted(r["id"] for r in P.lines_within(df, "line", "id", network, 0.5).collect()) == [1, 3, 4, 7]


def test_corridor_is_left_between_close_points(spark):
    """A gap of the network that no sampling at steps of d would see, and one that the ends of its pieces just close."""
    at = "x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(0.0, 0.0), (49.0, 0.0)]), (3, [(30.0, 1.0), (70.0, 1.0)])], "id int, line array<struct<x:double,y:double>>")
    open_ = spark.createDataFrame([(0.0, 0.0, 48.99, 0.0), (51.0, 0.0, 100.0, 0.0)], at)
    closed = spark.createDataFrame([(0.0, 0.0, 49.0, 0.0), (51.0, 0.0, 100.0, 0.0), (51.0, 0.0, 100.0, 0.0)], at)
    assert {r["id"] for r in P.lines_within(df, "line", "id", open_, 1.0).collect()} == {2}
    assert {r["id"] for r in P.lines_within(df, "line", "id", closed, 1.0).collect()} == {1, 2}
    assert P.lines_within(df, "line", "id", closed.limit(0), 1.0).count() == 0
    # along the edge of the corridor, at its very distance; the last one leaves it by a thousandth
    edge = spark.createDataFrame([(i, [(0.0, y), (100.0, y)]) for i, y in enumerate((1.0, -1.0, 1.001))], "id int, line array<struct<x:double,y:double>>")
    whole = spark.createDataFrame([(0.1 * i, 0.0, 0.1 * i + 0.1, 0.0) for i in range(1000)], at)
    assert {r["id"] for r in P.lines_within(edge, "line", "id", whole, 1.0).collect()} == {0, 1}


@pytest.mark.parametrize("cell", [None, 0.7, 50.0])
def test_corridor_matches_dense_points(spark, cell):
    rnd = random.Random(11)
    net = [(x, y, x + rnd.uniform(-3, 3), y + rnd.uniform(-3, 3)) for x, y in ((rnd.uniform(0, 12), rnd.uniform(0, 12)) for _ in range(60))]
    rows = []
    for i in range(120):
        x, y, r = rnd.uniform(0, 12), rnd.uniform(0, 12), rnd.choice([0.0, 2.0, 6.0])
        rows.append((i, [(x + rnd.uniform(-r, r), y + rnd.uniform(-r, r)) for _ in range(3)]))

    def far(px, py):
        best = 9e9
        for a, b, c, e in net:
            square = (c - a) ** 2 + (e - b) ** 2
            t = max(0.0, min(1.0, ((px - a) * (c - a) + (py - b) * (e - b)) / square))
            best = min(best, math.hypot(px - a - t * (c - a), py - b - t * (e - b)))
        return best

    most = {
        i: max(far(p[0] + k / 400 * (q[0] - p[0]), p[1] + k / 400 * (q[1] - p[1])) for p, q in zip(line, line[1:]) for k in range(401))
        for i, line in rows
    }
    df = spark.createDataFrame(rows, "id int, line array<struct<x:double,y:double>>")
    network = spark.createDataFrame(net, "x1 double, y1 double, x2 double, y2 double")
    got = {r["id"] for r in P.lines_within(df, "line", "id", network, 1.0, cell).collect()}
    clear = {i for i, m in most.items() if abs(m - 1.0) > 0.01}
    assert 20 < len(got) < 100 and got & clear == {i for i in clear if most[i] < 1.0}


def test_corridor_of_a_dense_network_meets_few_of_its_pieces(spark, monkeypatch):
    """Two thousand pieces in one square: lines in it and one that leaves it do not meet them all."""
    rnd = random.Random(5)
    spots = [(rnd.uniform(0, 20), rnd.uniform(0, 20)) for _ in range(2000)]
    network = spark.createDataFrame([(x, y, x + 1.0, y + 1.0) for x, y in spots], "x1 double, y1 double, x2 double, y2 double")
    rows = [(i, [(1.0 + 0.1 * i, 2.0), (2.0 + 0.1 * i, 19.0)]) for i in range(100)]
    rows += [(100, [(10.0, 10.0), (10.0, 40.0)]), (101, [(5.0, 5.0), (5.0, 5.0)]), (102, [(5.0, 50.0), (5.0, 50.0)])]
    df = spark.createDataFrame(rows, "id int, line array<struct<x:double,y:double>>")
    met, join = [], P.cell_join

    def counted(*args):
        out = join(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(P, "cell_join", counted)
    assert {r["id"] for r in P.lines_within(df, "line", "id", network, 5.0).collect()} == {*range(100), 101}
    assert sum(met) < 20_000


SQUARE = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
CASES = {
    "plain": ([SQUARE], True),
    "repeated point": ([ring((0, 0), (10, 0), (10, 0), (10, 10), (0, 10), (0, 0))], True),
    "hole": ([SQUARE, ring((2, 2), (4, 2), (4, 4), (2, 2))], True),
    "hole at a point of the shell": ([SQUARE, ring((0, 5), (4, 4), (4, 6), (0, 5))], True),
    "vertex on its own edge": ([ring((0, 0), (10, 0), (10, 10), (5, 0), (0, 10), (0, 0))], False),
    "spike": ([ring((0, 0), (10, 0), (10, 10), (10, 15), (10, 10), (0, 10), (0, 0))], False),
    "hole outside": ([SQUARE, ring((20, 20), (24, 20), (24, 24), (20, 20))], False),
    "hole along the shell": ([SQUARE, ring((0, 2), (4, 2), (0, 8), (0, 2))], False),
    "bow": ([ring((0, 0), (10, 10), (10, 0), (0, 10), (0, 0))], False),
    "open": ([ring((0, 0), (10, 0), (10, 10))], False),
}


def test_validity_of_touching_spiked_and_misplaced_rings(spark):
    df = spark.createDataFrame([(k, rings) for k, (rings, _) in CASES.items()], "id string, rings array<array<struct<x:double,y:double>>>")
    got = {r["id"]: r["valid"] for r in P.validity(df, "rings", "id").collect()}
    assert got == {k: v for k, (_, v) in CASES.items()}


def test_one_large_area_beside_many_small_ones(spark):
    """The index grows with the outline of the large area, and points are found at every level of its inside."""
    def square(i, x, y, side):
        return (i, [ring((x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y))])

    small = [square(i, i % 100 + 0.25, i // 100 + 0.25, 0.5) for i in range(2000)]
    df = spark.createDataFrame([*small, square(-1, 0.3, 0.3, 400.0)], "id int, rings array<array<struct<x:double,y:double>>>")
    alone = df.filter("id >= 0")
    cell = P.auto_cell(alone, "rings")
    added = P.polygon_cells(df, "rings", ["id"], cell).count() - P.polygon_cells(alone, "rings", ["id"], cell).count()
    assert added < 20 * 4 * 400 / cell
    pts = spark.range(4000).select("id", (F.col("id") * 7919 % 9973 / 20.0 + 0.013).alias("x"), (F.col("id") * 104729 % 9967 / 20.0 + 0.013).alias("y"))
    got = sorted((r["pid"], r["id"]) for r in P.points_in_area(pts.withColumnRenamed("id", "pid"), df, "rings", cell).collect())
    want = []
    for r in pts.collect():
        if 0.3 < r["x"] < 400.3 and 0.3 < r["y"] < 400.3:
            want.append((r["id"], -1))
        i = int(r["y"]) * 100 + int(r["x"])
        if r["x"] < 100 and i < 2000 and 0.25 < r["x"] % 1 < 0.75 and 0.25 < r["y"] % 1 < 0.75:
            want.append((r["id"], i))
    assert got == sorted(want)


def test_exact_side_of_near_collinear_points(spark):
    from fractions import Fraction

    rand = random.Random(5)
    rows = []
    for i in range(400):
        ax, ay, bx, by = (rand.uniform(-1e6, 1e6) for _ in range(4))
        t = rand.uniform(-0.5, 1.5)
        cx, cy = ax + t * (bx - ax), ay + t * (by - ay)
        for _ in range(rand.randrange(3)):
            cx = math.nextafter(cx, math.inf * rand.choice([-1, 1]))
        if i % 5 == 0:  # exactly on the line
            step = [float(rand.randrange(-999, 999)) / 8 for _ in range(2)]
            ax, ay = 0.1, 1 / 3
            bx, by, cx, cy = ax, ay + step[1], ax, ay + 3 * step[1]
        rows.append((i, ax, ay, bx, by, cx, cy))
    df = spark.createDataFrame(rows, "i int, ax double, ay double, bx double, by double, cx double, cy double")
    got = {r["i"]: r["s"] for r in df.select("i", G.orient_signs([[F.col(c) for c in df.columns[1:]]])[0].alias("s")).collect()}

    def exact(ax, ay, bx, by, cx, cy):
        ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
        d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        return (d > 0) - (d < 0)

    assert got == {r[0]: exact(*r[1:]) for r in rows}
    assert {-1, 0, 1} == set(got.values())


def test_clip_leaves_no_slivers(spark):
    """Lines through vertices and over shared edges: runs meet exactly, and touching a corner gives none."""
    left = ring((0.1, 0.1), (1.3, 0.1), (1.7, 2.3), (0.1, 2.3), (0.1, 0.1))
    right = ring((1.3, 0.1), (3.1, 0.1), (3.1, 2.3), (1.7, 2.3), (1.3, 0.1))
    spike = ring((5.1, 0.0), (6.3, 0.7), (5.1, 1.4), (4.9, 0.7), (5.1, 0.0))
    areas = spark.createDataFrame([(1, [left]), (2, [right]), (3, [spike])], f"area int, {RINGS}")
    lines = [
        (1, [(0.5, 0.7), (2.9, 1.9)]),  # over the shared edge
        (2, [(1.3 - 0.7, 0.1 - 0.3), (1.3, 0.1), (1.3 + 0.35, 0.1 + 0.3)]),  # into the corner both share
        (3, [(4.0, 0.7), (7.0, 0.7)]),  # through two corners of the spike
        (4, [(6.3, -1.0), (6.3, 3.0)]),  # touches one corner
        (5, [(4.0, 0.0), (7.0, 0.0)]),  # touches the lowest corner
    ]
    df = spark.createDataFrame(lines, f"id int, {LINE}")
    runs = {(r["id"], r["area"]): r["lines"] for r in P.clip_lines(df, "line", "id", areas, "rings", "area", 0.7).collect()}
    assert {k: len(v) for k, v in runs.items() if k[0] != 2} == {(1, 1): 1, (1, 2): 1, (3, 3): 1}
    assert runs[1, 1][0][-1] == runs[1, 2][0][0]
    assert [(p["x"], p["y"]) for p in runs[3, 3][0]] == [(pytest.approx(4.9), 0.7), (pytest.approx(6.3), 0.7)]
    assert sum(len(v) for k, v in runs.items() if k[0] == 2) == 1


def test_point_in_area_whose_corners_lie_on_cell_sides(spark):
    """9 * 0.7 and 6.3 are not the same double."""
    spike = ring((5.1, 0.0), (6.3, 0.7), (5.1, 1.4), (4.9, 0.7), (5.1, 0.0))
    areas = spark.createDataFrame([(3, [spike])], f"area int, {RINGS}")
    pts = spark.createDataFrame([(1, 6.65, 0.7), (2, 5.5, 0.7), (3, 4.5, 0.7), (4, 6.65, 0.8)], "pid int, x double, y double")
    for cell in (0.7, 0.35, 0.1, 0.3, 1.0):
        assert [r["pid"] for r in P.points_in_area(pts, areas, "rings", cell).collect()] == [2]
