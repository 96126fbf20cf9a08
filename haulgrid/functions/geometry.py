"""Geometry as nested columns: point ``struct<x,y>``, line = array of points, polygon = array of rings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .nulls import as_col

# GRS80 ellipsoid, US survey foot, mean earth radius in metres.
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
US_FOOT = 1200.0 / 3937.0
EARTH_RADIUS = 6371010.0

# State-plane zone 6501: Lambert conic, two standard parallels, origin, false offsets in metres.
ZONE_6501 = {
    "lat1": 45 + 37 / 60, "lat2": 47 + 3 / 60, "lat0": 45.0, "lon0": -94.25, "false_e": 800000.0, "false_n": 100000.0,
}


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where it is used inside a lambda."""
    return F.transform(F.array(value), use)[0]


def point(x: Column | str, y: Column | str) -> Column:
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"))


def force_2d(points: Column | str) -> Column:
    """A line whose points carry more than x and y, cut down to them."""
    return F.transform(as_col(points), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def pairs(line: Column) -> Column:
    """Consecutive points of a line as ``array<struct<x1,y1,x2,y2>>``."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(
        F.slice(line, F.lit(1), n),
        F.slice(line, F.lit(2), n),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def ring_edges(polygon: Column) -> Column:
    """All edges of all rings in one array."""
    return F.flatten(F.transform(polygon, pairs))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def great_circle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres between two lon/lat points on a sphere."""
    dlat, dlon = F.radians(y2 - y1), F.radians(x2 - x1)
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(
        F.sin(dlon / 2), F.lit(2.0)
    )
    return 2 * EARTH_RADIUS * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def length(line: Column | str, geodesic: bool = False) -> Column:
    """Planar length in coordinate units, or metres along great circles for lon/lat."""
    if geodesic:
        parts = F.transform(pairs(as_col(line)), lambda s: great_circle(s["x1"], s["y1"], s["x2"], s["y2"]))
    else:
        parts = F.transform(pairs(as_col(line)), lambda s: F.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]))
    return _total(parts)


def ring_area(ring: Column) -> Column:
    """Signed area: positive counter-clockwise. Taken relative to the first point to keep digits."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    cross = F.transform(
        pairs(ring), lambda s: (s["x1"] - x0) * (s["y2"] - y0) - (s["x2"] - x0) * (s["y1"] - y0)
    )
    return _total(cross) / 2


def area(polygon: Column | str) -> Column:
    """Outer ring less holes."""
    rings = F.transform(as_col(polygon), lambda r: F.abs(ring_area(r)))
    return let(rings, lambda a: 2 * a[0] - _total(a))


def multi_area(polygons: Column | str) -> Column:
    return _total(F.transform(as_col(polygons), area))


def depth(df: DataFrame, col: str) -> int:
    """Levels of arrays in a geometry column: line 1, polygon or multi-part line 2, multi-part polygon 3."""
    kind, levels = df.schema[col].dataType, 0
    while isinstance(kind, T.ArrayType):
        kind, levels = kind.elementType, levels + 1
    return levels


def all_rings(df: DataFrame, col: str) -> Column:
    """The rings of an area, of one part or of many; parts do not overlap, so even-odd tests hold over all rings."""
    return F.flatten(F.col(col)) if depth(df, col) == 3 else F.col(col)


def whole_area(df: DataFrame, col: str) -> Column:
    """Area of one part or of many."""
    return multi_area(col) if depth(df, col) == 3 else area(col)


def whole_length(df: DataFrame, col: str, geodesic: bool = False) -> Column:
    """Length of a line of one part or of many."""
    if depth(df, col) == 1:
        return length(col, geodesic)
    return _total(F.transform(col, lambda part: length(part, geodesic)))


def inner_point(df: DataFrame, col: str) -> Column:
    """A point inside an area; of many parts, inside the largest one (the first of equal ones)."""
    if depth(df, col) != 3:
        return point_on_surface(col)
    sized = F.transform(col, lambda part, i: F.struct((-area(part)).alias("a"), i.alias("i"), part.alias("p")))
    return let(F.array_min(sized)["p"], point_on_surface)


def bearing(line: Column | str) -> Column:
    """Initial great-circle bearing from first to last point, -180 to 180 degrees."""
    line = as_col(line)
    a, b = line[0], F.element_at(line, -1)
    lat1, lat2, dlon = F.radians(a["y"]), F.radians(b["y"]), F.radians(b["x"] - a["x"])
    return F.degrees(
        F.atan2(
            F.sin(dlon) * F.cos(lat2), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(dlon)
        )
    )


def crossing_x(edge: Column, y: Column) -> Column:
    return edge["x1"] + (y - edge["y1"]) * (edge["x2"] - edge["x1"]) / (edge["y2"] - edge["y1"])


def crosses_level(edge: Column, y: Column) -> Column:
    """Edge passes the horizontal line y; an end on the line counts as below it."""
    return (edge["y1"] <= y) != (edge["y2"] <= y)


def contains(polygon: Column | str, x: Column, y: Column) -> Column:
    """Even-odd test of a point against all rings."""
    left = F.filter(
        ring_edges(as_col(polygon)), lambda e: F.when(crosses_level(e, y), crossing_x(e, y) < x).otherwise(False)
    )
    return F.size(left) % 2 == 1


def point_on_surface(polygon: Column | str) -> Column:
    """A point inside: the middle of the widest inner stretch of the line at half height."""

    def widest(xs: Column) -> Column:
        starts = F.filter(xs, lambda _, i: i % 2 == 0)
        ends = F.filter(xs, lambda _, i: i % 2 == 1)
        return F.array_max(
            F.zip_with(starts, ends, lambda a, b: F.struct((b - a).alias("w"), ((a + b) / 2).alias("x")))
        )["x"]

    def at_height(edges: Column) -> Column:
        ys = F.transform(edges, lambda e: e["y1"])

        def inner(y: Column) -> Column:
            crossings = F.transform(F.filter(edges, lambda e: crosses_level(e, y)), lambda e: crossing_x(e, y))
            return F.struct(let(F.array_sort(crossings), widest).alias("x"), y.alias("y"))

        return let(let(ys, lambda v: (F.array_min(v) + F.array_max(v)) / 2), inner)

    return let(ring_edges(as_col(polygon)), at_height)


def is_ring_valid(ring: Column) -> Column:
    """Closed, at least four points, finite, with an area."""
    first, last = ring[0], F.element_at(ring, -1)
    finite = F.forall(
        ring,
        lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")),
    )
    return F.coalesce(
        (F.size(ring) >= 4) & (first["x"] == last["x"]) & (first["y"] == last["y"]) & finite
        & (F.abs(ring_area(ring)) > 0),
        F.lit(False),
    )


# ---- projection ----------------------------------------------------------------------------------------


def _cone(zone: dict) -> tuple[float, float, float, float]:
    e = math.sqrt(GRS80_F * (2 - GRS80_F))

    def m(lat):
        return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)

    def t(lat):
        s = e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    lat1, lat2, lat0 = (math.radians(zone[k]) for k in ("lat1", "lat2", "lat0"))
    n = (math.log(m(lat1)) - math.log(m(lat2))) / (math.log(t(lat1)) - math.log(t(lat2)))
    f = m(lat1) / (n * t(lat1) ** n)
    return e, n, f, GRS80_A * f * t(lat0) ** n


def to_state_plane(p: Column, zone: dict = ZONE_6501) -> Column:
    """Lon/lat degrees to state-plane US survey feet."""
    e, n, f, rho0 = _cone(zone)
    lat = F.radians(p["y"])
    s = e * F.sin(lat)
    t = F.tan(math.pi / 4 - lat / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    rho = GRS80_A * f * F.pow(t, F.lit(n))
    theta = n * F.radians(p["x"] - zone["lon0"])
    return F.struct(
        ((zone["false_e"] + rho * F.sin(theta)) / US_FOOT).alias("x"),
        ((zone["false_n"] + rho0 - rho * F.cos(theta)) / US_FOOT).alias("y"),
    )


def to_lon_lat(p: Column, zone: dict = ZONE_6501) -> Column:
    """State-plane US survey feet to lon/lat degrees; latitude from the conformal latitude by its series."""
    e, n, f, rho0 = _cone(zone)
    dx = p["x"] * US_FOOT - zone["false_e"]
    dy = rho0 - (p["y"] * US_FOOT - zone["false_n"])
    t = F.pow(F.hypot(dx, dy) / (GRS80_A * f), F.lit(1 / n))
    chi = math.pi / 2 - 2 * F.atan(t)
    e2, e4, e6, e8 = e**2, e**4, e**6, e**8
    lat = (
        chi
        + (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(2 * chi)
        + (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(4 * chi)
        + (7 * e6 / 120 + 81 * e8 / 1120) * F.sin(6 * chi)
        + (4279 * e8 / 161280) * F.sin(8 * chi)
    )
    return F.struct((zone["lon0"] + F.degrees(F.atan2(dx, dy) / n)).alias("x"), F.degrees(lat).alias("y"))


def project(geom: Column | str, src: int, dst: int, depth: int = 1) -> Column:
    """Reproject between 4326 and 6501; ``depth`` is 0 for points, 1 for lines, 2 for polygons, 3 for multi."""
    geom = as_col(geom)
    if src == dst:
        return geom
    steps = {(4326, 6501): to_state_plane, (6501, 4326): to_lon_lat}
    if (src, dst) not in steps:
        raise ValueError(f"no projection from {src} to {dst}")

    def apply(c: Column, d: int) -> Column:
        return steps[(src, dst)](c) if d == 0 else F.transform(c, lambda part: apply(part, d - 1))

    return apply(geom, depth)


# ---- distances on scalar columns -----------------------------------------------------------------------


def point_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - x1) * dx + (py - y1) * dy) / len2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def orient(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


#: What one half of a double has at most, and how far the rounded determinant may be off per unit of its two products.
_SPLITTER, _ORIENT_BOUND = 2.0**27 + 1, (3 + 16 * 2.0**-53) * 2.0**-53


def _exact_product(a: Column, b: Column) -> Column:
    """``a * b`` as two doubles that add up to it exactly, the smaller one first."""

    def halves(c: Column) -> tuple[Column, Column]:
        high = c * _SPLITTER - (c * _SPLITTER - c)
        return high, c - high

    (a1, a2), (b1, b2) = halves(a), halves(b)
    return F.array(a2 * b2 - (((a * b - a1 * b1) - a2 * b1) - a1 * b2), a * b)


def _exact_sign(terms: Column) -> Column:
    """Sign of the sum of an array of doubles: they are added to an expansion whose last number that is not 0 has the sum's sign."""
    none = F.array().cast("array<double>")

    def add(carry: Column, part: Column) -> Column:
        total = carry["q"] + part
        there = total - carry["q"]
        lost = (carry["q"] - (total - there)) + (part - there)
        return F.struct(total.alias("q"), F.concat(carry["out"], F.array(lost)).alias("out"))

    grown = F.aggregate(
        terms, none,
        lambda parts, term: F.aggregate(
            parts, F.struct(term.alias("q"), none.alias("out")), add, lambda c: F.concat(c["out"], F.array(c["q"]))
        ),
    )
    return F.aggregate(grown, F.lit(0.0), lambda sign, part: F.when(part != 0, F.signum(part)).otherwise(sign))


def surely_beside(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Both ends of ``b`` lie on one side of the line of ``a``, by more than rounding; False says nothing."""

    def beyond(x: Column, y: Column, sign: int) -> Column:
        left, right = (a[2] - a[0]) * (y - a[1]), (a[3] - a[1]) * (x - a[0])
        return (left - right) * sign > (F.abs(left) + F.abs(right)) * _ORIENT_BOUND

    return (beyond(b[0], b[1], 1) & beyond(b[2], b[3], 1)) | (beyond(b[0], b[1], -1) & beyond(b[2], b[3], -1))


def orient_signs(points: Sequence[Sequence[Column]]) -> Column:
    """Exact signs of ``orient`` (1, -1 or 0) of each six coordinates, as an array: rounded where an error bound proves it, by
    exact sums of products elsewhere. For rows that need it: lambdas are not compiled."""

    def sign(p: Column) -> Column:
        ax, ay, bx, by, cx, cy = (p[c] for c in ("ax", "ay", "bx", "by", "cx", "cy"))
        left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
        sure = F.abs(left - right) >= (F.abs(left) + F.abs(right)) * _ORIENT_BOUND
        factors = [(bx, cy), (-bx, ay), (-ax, cy), (-by, cx), (by, ax), (ay, cx)]
        products = F.transform(
            F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in factors]), lambda f: _exact_product(f["a"], f["b"])
        )
        return F.when(sure, F.signum(left - right)).otherwise(_exact_sign(F.flatten(products)))

    names = ("ax", "ay", "bx", "by", "cx", "cy")
    return F.transform(F.array(*[F.struct(*[c.alias(n) for n, c in zip(names, p)]) for p in points]), sign)


def segments_cross(a: list[Column], b: list[Column]) -> Column:
    """Both segments pass each other's line strictly."""
    d1 = orient(*b, a[0], a[1])
    d2 = orient(*b, a[2], a[3])
    d3 = orient(*a, b[0], b[1])
    d4 = orient(*a, b[2], b[3])
    return ((d1 > 0) != (d2 > 0)) & ((d3 > 0) != (d4 > 0)) & (d1 * d2 < 0) & (d3 * d4 < 0)


def on_segment(px: Column, py: Column, s: list[Column]) -> Column:
    """A point lies on a segment, ends included."""
    in_box = px.between(F.least(s[0], s[2]), F.greatest(s[0], s[2])) & py.between(F.least(s[1], s[3]), F.greatest(s[1], s[3]))
    return in_box & (orient(*s, px, py) == 0)


def segments_touch(a: list[Column], b: list[Column]) -> Column:
    """An end of one segment lies on the other."""
    return on_segment(a[0], a[1], b) | on_segment(a[2], a[3], b) | on_segment(b[0], b[1], a) | on_segment(b[2], b[3], a)


def segments_overlap(a: list[Column], b: list[Column]) -> Column:
    """Both segments run along one line and share more than a point."""
    along = (orient(*a, b[0], b[1]) == 0) & (orient(*a, b[2], b[3]) == 0)

    def shared(i: int) -> Column:
        return F.greatest(F.least(a[i], a[i + 2]), F.least(b[i], b[i + 2])) < F.least(
            F.greatest(a[i], a[i + 2]), F.greatest(b[i], b[i + 2])
        )

    return along & (shared(0) | shared(1))


def segment_segment(a: list[Column], b: list[Column]) -> Column:
    """Distance between two segments: 0 if they cross, else the smallest end-to-segment distance."""
    ends = F.least(
        point_segment(a[0], a[1], *b), point_segment(a[2], a[3], *b),
        point_segment(b[0], b[1], *a), point_segment(b[2], b[3], *a),
    )
    return F.when(segments_cross(a, b), F.lit(0.0)).otherwise(ends)
