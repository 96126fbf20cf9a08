"""Spatial joins and geometry reshaping as grid-keyed equi-joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import materialize

ENDS = ["x1", "y1", "x2", "y2"]


# ---- tables of vertices, segments and cells ------------------------------------------------------------


#: Numbers that the pieces of a line's next part are ahead of those of the part before.
PART = 1 << 32


def line_parts(df: DataFrame, line: str, part: str = "line_part") -> DataFrame:
    """One row per part of lines with many parts, with its number."""
    others = [c for c in df.columns if c != line]
    return df.select(*others, F.posexplode(line).alias(part, line))


def vertices(df: DataFrame, line: str, keep: Sequence[str]) -> DataFrame:
    """One row per vertex with its position; parts of a line are PART numbers apart."""
    if G.depth(df, line) == 2:
        parts = vertices(line_parts(df.select(*keep, line), line), line, [*keep, "line_part"])
        return parts.withColumn("vertex", F.col("line_part") * F.lit(PART) + F.col("vertex")).drop("line_part")
    return df.select(*keep, F.posexplode(line).alias("vertex", "p")).select(*keep, "vertex", "p.x", "p.y")


def segments(df: DataFrame, line: str, keep: Sequence[str]) -> DataFrame:
    """One row per straight piece: ``seg``, ``x1``, ``y1``, ``x2``, ``y2``; parts of a line are PART numbers apart."""
    if G.depth(df, line) == 2:
        parts = segments(line_parts(df.select(*keep, line), line), line, [*keep, "line_part"])
        return parts.withColumn("seg", F.col("line_part") * F.lit(PART) + F.col("seg")).drop("line_part")
    return df.select(*keep, F.posexplode(G.pairs(F.col(line))).alias("seg", "s")).select(*keep, "seg", "s.*")


def polygon_edges(df: DataFrame, polygon: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.explode(G.ring_edges(G.all_rings(df, polygon))).alias("s")).select(*keep, "s.*")


def _index(c: Column, cell: float, origin: float = 0.0) -> Column:
    return F.floor((c - origin) / cell)


def point_cell(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    return df.withColumns({"cx": _index(F.col(x), cell), "cy": _index(F.col(y), cell)})


def segment_cells(df: DataFrame, cell: float, pad: float = 0.0, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """One row per grid cell a segment touches, or comes within ``pad`` of.

    Walks the columns of cells the segment spans and in each only the rows its own part reaches, so the
    number of cells grows with its length and not with the area of its box.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    dx, dy = x2 - x1, y2 - y1
    by_column = df.withColumn(
        "cx",
        F.explode(F.sequence(_index(F.least(x1, x2) - pad, cell, x0), _index(F.greatest(x1, x2) + pad, cell, x0))),
    )

    def y_at(x: Column) -> Column:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - x1) / dx))
        return y1 + t * dy

    west = F.col("cx") * cell + (x0 - pad)
    east = (F.col("cx") + 1) * cell + (x0 + pad)
    lo = F.when(dx == 0, F.least(y1, y2)).otherwise(F.least(y_at(west), y_at(east)))
    hi = F.when(dx == 0, F.greatest(y1, y2)).otherwise(F.greatest(y_at(west), y_at(east)))
    return by_column.withColumn("cy", F.explode(F.sequence(_index(lo - pad, cell, y0), _index(hi + pad, cell, y0))))


def auto_cell(polys: DataFrame, rings: str) -> float:
    """Grid size for a layer of areas: a few edges to a boundary cell, and 4 to 64 cells across an average area."""
    edges = G.ring_edges(G.all_rings(polys, rings))
    xs, ys = F.transform(edges, lambda e: e["x1"]), F.transform(edges, lambda e: e["y1"])
    span = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    lengths = F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))
    s = polys.select(span.alias("span"), lengths.alias("len"), F.size(edges).alias("n")).agg(
        F.avg("span").alias("span"), F.sum("len").alias("len"), F.sum("n").alias("n")
    ).first()
    if not s["n"]:
        return 1.0
    return max(min(4.0 * s["len"] / s["n"], s["span"] / 4.0), s["span"] / 64.0) or 1.0


#: Part of a cell by which rounding may put an edge on a cell's side into the next cell; edges that close are listed in both.
EDGE = 1e-9

#: Cells of the inside get coarser by 2 ** STEP at a time.
STEP = 3


def polygon_cells(df: DataFrame, rings: str, keep: Sequence[str], cell: float) -> DataFrame:
    """Polygons cut into grid cells so that a point test only meets the edges of its own cell.

    Each row holds a cell's level and place, its corner, how many edges lie below that corner, and the edges that touch the
    cell. Cells with edges are of the given size (level 0). The inside is covered by the largest cells of levels 0, 3, 6 …
    (2 ** level times as wide) that no edge touches, so the number of cells grows with a polygon's outline and not with
    its area. Edges are listed one by one and counted along columns of cells: no task holds a whole polygon's cells.
    """
    base = materialize(df.select(*keep, G.all_rings(df, rings).alias("__rings")), "areas", "__pid")
    edges = polygon_edges(base, "__rings", ["__pid"])
    touched = materialize(
        segment_cells(edges, cell, pad=cell * EDGE).groupBy("__pid", "cx", "cy").agg(F.collect_list(F.struct(*ENDS)).alias("near")),
        "outline-cells",
    )
    spans = edges.groupBy("__pid").agg(*[
        (F.max(F.greatest(p, q)) - F.min(F.least(p, q))).alias(n) for n, p, q in (("w", "x1", "x2"), ("h", "y1", "y2"))
    ])
    widest = spans.agg(F.max(F.greatest("w", "h"))).first()[0] or 0.0
    top = STEP * math.ceil(math.log2(max(widest / cell, 1.0)) / STEP + 1e-9)
    # the cells of all levels that an edge touches; a cell as wide as the polygon cannot lie inside it
    lv = F.explode(F.array(*[F.lit(k) for k in range(0, top + 1, STEP)]))
    scale = F.pow(F.lit(2.0), F.col("lv"))
    outline = touched.select("__pid", "cx", "cy", lv.alias("lv")).select(
        "__pid", "lv", F.floor(F.col("cx") / scale).alias("cx"), F.floor(F.col("cy") / scale).alias("cy")
    ).distinct()
    fan = 2**STEP
    parts = outline.filter("lv > 0").select(
        "__pid", (F.col("lv") - STEP).alias("lv"),
        F.explode(F.sequence(F.col("cx") * fan, F.col("cx") * fan + fan - 1)).alias("cx"), "cy",
    ).select("__pid", "lv", "cx", F.explode(F.sequence(F.col("cy") * fan, F.col("cy") * fan + fan - 1)).alias("cy"))
    inner = parts.join(outline, ["__pid", "lv", "cx", "cy"], "left_anti").withColumn("near", F.array().cast(touched.schema["near"].dataType))
    cells = touched.withColumn("lv", F.lit(0)).unionByName(inner).withColumns({
        "col": (F.col("cx") * scale).cast("long"), "row": (F.col("cy") * scale).cast("long"), "mark": F.lit(1),
    }).withColumns({"west": F.col("col") * cell, "south": F.col("row") * cell}).withColumn("at", F.col("south"))
    # where edges pass the west sides of columns
    first, last = _index(F.least("x1", "x2"), cell), _index(F.greatest("x1", "x2"), cell) + 1
    passed = edges.withColumn("col", F.explode(F.sequence(first, last))).withColumn("west", F.col("col") * cell)
    e = {c: F.col(c) for c in ENDS}
    passes = passed.filter((F.col("x1") < F.col("west")) != (F.col("x2") < F.col("west"))).select(
        "__pid", "col", _level_at(e, F.col("west")).alias("at"), F.lit(0).alias("mark")
    )
    column = Window.partitionBy("__pid", "col").orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, 0)
    counted = cells.unionByName(passes, allowMissingColumns=True).withColumn(
        "below_corner", F.sum(1 - F.col("mark")).over(column).cast("int")
    )
    found = counted.filter((F.col("mark") == 1) & ((F.size("near") > 0) | (F.col("below_corner") % 2 == 1)))
    return found.join(base.select("__pid", *keep), "__pid").select(
        *keep, "lv", "cx", "cy", "west", "south", "below_corner", "near"
    )


def _level_at(e: Column, x: Column) -> Column:
    return e["y1"] + (x - e["x1"]) * (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])


def _in_cell_polygon(x: Column, y: Column) -> Column:
    """Even-odd test along the cell's west side up to the point's height and then east to the point.

    An end on the west side counts as east of it, an end at the point's height as below. An edge that passes the side and the
    height is on one side of the bend, and that one answer settles where it meets both, so rounding cannot count it twice.
    """
    west, south = F.col("west"), F.col("south")

    def passes(e: Column) -> Column:
        return (e["x1"] < west) != (e["x2"] < west)

    def under_bend(e: Column) -> Column:
        return F.when(G.crosses_level(e, y), _level_at(e, west) <= y).otherwise(e["y1"] <= y)

    def east_of_bend(e: Column) -> Column:
        rises = (e["x1"] < e["x2"]) == (e["y1"] < e["y2"])
        return F.when(passes(e), under_bend(e) == rises).otherwise(e["x1"] >= west)

    up = F.filter("near", lambda e: F.when(passes(e), under_bend(e) != (_level_at(e, west) <= south)).otherwise(False))
    along = F.filter(
        "near", lambda e: F.when(G.crosses_level(e, y), east_of_bend(e) & (G.crossing_x(e, y) < x)).otherwise(False)
    )
    return (F.col("below_corner") + F.size(up) + F.size(along)) % 2 == 1


# ---- joins ---------------------------------------------------------------------------------------------


def cell_join(left: DataFrame, index: DataFrame, how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Equi-join on the grid cell plus an exact test.

    A crowded cell is a skewed shuffle partition of ``left``, which adaptive execution splits over tasks by
    map output, whatever the number of rows with that one key. The index must be a written table: the planner
    does not see how many rows an explode makes, so only then does it broadcast by a measured size.
    """
    index = index.withColumnsRenamed({"cx": "__cx", "cy": "__cy"})
    on = (F.col("cx") == F.col("__cx")) & (F.col("cy") == F.col("__cy"))
    joined = left.join(index, on if condition is None else on & condition, how)
    return joined.drop("cx", "cy", "__cx", "__cy")


def points_in_area(
    pts: DataFrame, polys: DataFrame, rings: str, cell: float | None = None, x: str = "x", y: str = "y"
) -> DataFrame:
    """Points inside an area with the area's attributes; a point in two areas comes out twice."""
    cell = cell or auto_cell(polys, rings)
    keep = [c for c in polys.columns if c != rings]
    placed = point_cell(pts.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y, cell)
    index = materialize(polygon_cells(polys, rings, keep, cell), "area-cells")
    levels = sorted(r["lv"] for r in index.select("lv").distinct().collect())
    inside = _in_cell_polygon(F.col(x), F.col(y))
    if any(levels):
        scale = F.pow(F.lit(2.0), F.col("__lv"))
        placed = placed.withColumn("__lv", F.explode(F.array(*[F.lit(k) for k in levels]))).withColumns(
            {"cx": F.floor(F.col("cx") / scale), "cy": F.floor(F.col("cy") / scale)}
        )
        inside = (F.col("__lv") == F.col("lv")) & inside
    hit = cell_join(placed, index, "inner", inside)
    return hit.drop("__lv", "lv", "west", "south", "below_corner", "near")


def spatial_join(
    polys: DataFrame,
    pts: DataFrame,
    rings: str,
    poly_id: str,
    cell: float | None = None,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Every area with the points inside it; an area without points comes out once with NULLs."""
    attributes = [c for c in polys.columns if c != rings]
    inside = points_in_area(pts, polys, rings, cell, x, y).select(*attributes, *pts.columns)
    matched = materialize(inside, "points-in-areas")  # used twice, computed once
    found = matched.select(F.col(poly_id).alias("__found")).distinct()
    empty = polys.select(*attributes).join(found, F.col(poly_id) == F.col("__found"), "left_anti")
    return matched.unionByName(empty, allowMissingColumns=True)


def _near_lines(
    pts: DataFrame, segs: DataFrame, d: float, how: str, cell: float | None, x: str, y: str
) -> DataFrame:
    cell = cell or 4.0 * d
    placed = point_cell(pts, x, y, cell)
    index = materialize(segment_cells(segs.select(*ENDS), cell, pad=d), "segment-cells")
    close = G.point_segment(F.col(x), F.col(y), *[F.col(c) for c in ENDS]) <= d
    return cell_join(placed, index, how, close)


def within_distance(
    pts: DataFrame, segs: DataFrame, d: float, cell: float | None = None, x: str = "x", y: str = "y"
) -> DataFrame:
    """Points at most ``d`` from any segment. The segments stay a table: no merged shape or buffer is made."""
    return _near_lines(pts, segs, d, "left_semi", cell, x, y)


def beyond_distance(
    pts: DataFrame, segs: DataFrame, d: float, cell: float | None = None, x: str = "x", y: str = "y"
) -> DataFrame:
    """Points more than ``d`` from every segment."""
    return _near_lines(pts, segs, d, "left_anti", cell, x, y)


def point_segments(df: DataFrame, keep: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Points as segments of no length, for the nearest join."""
    return df.select(
        *keep, F.lit(0).alias("seg"), F.col(x).alias("x1"), F.col(y).alias("y1"),
        F.col(x).alias("x2"), F.col(y).alias("y2"),
    )


FAN = 4  # a cell has FAN x FAN children
SMALL_LEVELS = 4  # FAN ** (2 * 4) = 65,536 cells at most: a proven bound for a broadcast
CELL_CAP = 1000
MAX_LEVELS = 12


def _grid(right: DataFrame) -> tuple[float, float, float, int] | None:
    """Origin, extent and depth of the cell tree over the right side."""
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    s = right.agg(
        F.min(F.least(x1, x2)).alias("x0"), F.max(F.greatest(x1, x2)).alias("xm"),
        F.min(F.least(y1, y2)).alias("y0"), F.max(F.greatest(y1, y2)).alias("ym"),
        F.count(F.lit(1)).alias("n"), F.avg(F.hypot(x2 - x1, y2 - y1)).alias("len"),
    ).first()
    if s["n"] == 0:
        return None
    extent = max(s["xm"] - s["x0"], s["ym"] - s["y0"], 1e-9) * (1 + 1e-9) + 1e-9
    # a cell shorter than a quarter of the mean segment would multiply the index
    deepest = MAX_LEVELS if s["len"] == 0 else max(1, min(MAX_LEVELS, int(math.log(4 * extent / s["len"], FAN))))
    levels = max(1, min(deepest, math.ceil(math.log(max(1.0, math.sqrt(s["n"]) / 2), FAN))))
    while levels < deepest and s["n"] > CELL_CAP:
        cell = extent / FAN**levels
        fullest = (
            segment_cells(right, cell, 0.0, s["x0"], s["y0"]).groupBy("cx", "cy").count().agg(F.max("count")).first()[0]
        )
        if fullest <= CELL_CAP:
            break
        levels += 1
    return s["x0"], s["y0"], extent, levels


def nearest_join(
    left: DataFrame, right: DataFrame, left_id: Sequence[str], right_id: str, distance: str = "distance"
) -> DataFrame:
    """For every left feature the nearest right feature and its distance; ties go to the smallest right id.

    Both sides are segment tables (``seg``, ``x1`` … ``y2``). A tree of grid cells over the right side is
    descended level by level for all left segments at once: a cell stays while its smallest possible
    distance does not exceed the smallest distance some cell guarantees. So each left segment meets a few
    cells per level, however unevenly either side is spread, and no search radius has to be guessed.
    """
    left_id = list(left_id)
    ids = left.select(*left_id).distinct()
    # equal geometry: only the smallest id can win
    unique = materialize(right.groupBy(*ENDS).agg(F.min(right_id).alias("__rid")), "nearest-right")
    grid = _grid(unique)
    if grid is None:
        rid_type = right.schema[right_id].dataType
        return ids.select("*", F.lit(None).cast(rid_type).alias(right_id), F.lit(None).cast("double").alias(distance))
    x0, y0, extent, levels = grid
    leaf = extent / FAN**levels
    leaves = materialize(segment_cells(unique, leaf, 0.0, x0, y0), "nearest-leaves")
    tables = {levels: materialize(leaves.select("cx", "cy").distinct(), "nearest-cells")}
    for k in range(levels - 1, 0, -1):
        tables[k] = tables[k + 1].select(
            F.floor(F.col("cx") / FAN).alias("cx"), F.floor(F.col("cy") / FAN).alias("cy")
        ).distinct()

    seg_key = [*left_id, "seg"]
    lx = {c: "__l" + c for c in ENDS}
    frontier = left.select(*seg_key, *[F.col(c).cast("double").alias(lx[c]) for c in ENDS]).withColumns(
        {"cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long")}
    )
    by_segment = Window.partitionBy(*seg_key)
    for k in range(1, levels + 1):
        size = extent / FAN**k
        children = tables[k].select(
            F.floor(F.col("cx") / FAN).alias("__px"), F.floor(F.col("cy") / FAN).alias("__py"),
            F.col("cx").alias("__nx"), F.col("cy").alias("__ny"),
        )
        if k <= SMALL_LEVELS:
            children = F.broadcast(children)
        met = frontier.join(children, (F.col("cx") == F.col("__px")) & (F.col("cy") == F.col("__py")))
        w, s = x0 + F.col("__nx") * size, y0 + F.col("__ny") * size
        ax, ay, bx, by = (F.col(lx[c]) for c in ENDS)
        gap_x = F.greatest(F.lit(0.0), w - F.greatest(ax, bx), F.least(ax, bx) - (w + size))
        gap_y = F.greatest(F.lit(0.0), s - F.greatest(ay, by), F.least(ay, by) - (s + size))
        far = F.hypot(F.greatest(F.abs(ax - w), F.abs(ax - (w + size))), F.greatest(F.abs(ay - s), F.abs(ay - (s + size))))
        frontier = (
            met.withColumns({"__lo": F.hypot(gap_x, gap_y), "__hi": far})
            .withColumn("__best", F.min("__hi").over(by_segment))
            .filter(F.col("__lo") <= F.col("__best") * (1 + 1e-9) + 1e-9)
            .select(*seg_key, *lx.values(), F.col("__nx").alias("cx"), F.col("__ny").alias("cy"))
        )

    pairs = cell_join(frontier, leaves)
    dist = G.segment_segment([F.col(c) for c in lx.values()], [F.col(c) for c in ENDS])
    best = (
        pairs.select(*left_id, dist.alias("__d"), "__rid")
        .groupBy(*left_id)
        .agg(F.min(F.struct("__d", "__rid")).alias("m"))
        .select(*[F.col(c).alias("__k_" + c) for c in left_id], F.col("m.__rid").alias(right_id),
                F.col("m.__d").alias(distance))
    )
    on = F.lit(True)
    for c in left_id:
        on = on & (F.col(c) == F.col("__k_" + c))
    return ids.join(best, on, "left").drop(*["__k_" + c for c in left_id])


# ---- lines ---------------------------------------------------------------------------------------------


def _regroup(parts: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Consecutive pieces back to one line per group; a group is never more than one line's pieces."""
    pieces = F.sort_array(F.collect_list(F.struct(*order, *ENDS)))
    line = F.concat(
        F.array(F.struct(F.col("__p")[0]["x1"].alias("x"), F.col("__p")[0]["y1"].alias("y"))),
        F.transform("__p", lambda s: F.struct(s["x2"].alias("x"), s["y2"].alias("y"))),
    )
    return parts.groupBy(*by).agg(pieces.alias("__p")).select(*by, line.alias(out))


def split_lines(df: DataFrame, line: str, line_id: Sequence[str], max_len: float) -> DataFrame:
    """Each line in n equal parts no longer than ``max_len``: ``part`` 1..n, ``n_parts`` and the part's line.

    A line of no length is one part, as it is; a NULL line or one without points has none. Of lines with many parts
    each part is cut by itself and numbered in ``line_part``.
    """
    line_id = list(line_id)
    if G.depth(df, line) == 2:
        return split_lines(line_parts(df.select(*line_id, line), line), line, [*line_id, "line_part"], max_len)
    still = (F.size(line) > 0) & (F.coalesce(G.length(line), F.lit(0.0)) == 0)
    one = F.lit(1)
    standing = df.filter(still).select(*line_id, one.alias("part"), one.alias("n_parts"), line)
    df = df.filter(G.length(line) > 0)
    segs = segments(df, line, line_id).withColumn("__len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    before = Window.partitionBy(*line_id).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*line_id)
    measured = segs.withColumns(
        {"__from": F.coalesce(F.sum("__len").over(before), F.lit(0.0)), "__total": F.sum("__len").over(whole)}
    ).withColumn("n_parts", F.greatest(F.lit(1), F.ceil(F.col("__total") / max_len).cast("int")))
    step = F.col("__total") / F.col("n_parts")
    last = F.col("n_parts") - 1
    first_part = F.least(last, F.floor(F.col("__from") / step).cast("int"))
    last_part = F.least(last, F.floor((F.col("__from") + F.col("__len")) / step).cast("int"))
    cut = measured.filter(F.col("__len") > 0).withColumn("__i", F.explode(F.sequence(first_part, last_part)))
    lo = F.greatest(F.lit(0.0), (F.col("__i") * step - F.col("__from")) / F.col("__len"))
    hi = F.when(F.col("__i") == last, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), ((F.col("__i") + 1) * step - F.col("__from")) / F.col("__len"))
    )
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    parts = cut.withColumns({"__lo": lo, "__hi": hi}).filter(F.col("__hi") - F.col("__lo") > 1e-12).select(
        *line_id, "n_parts", (F.col("__i") + 1).alias("part"), "seg",
        (x1 + F.col("__lo") * (x2 - x1)).alias("x1"), (y1 + F.col("__lo") * (y2 - y1)).alias("y1"),
        (x1 + F.col("__hi") * (x2 - x1)).alias("x2"), (y1 + F.col("__hi") * (y2 - y1)).alias("y2"),
    )
    cut_lines = _regroup(parts, [*line_id, "part", "n_parts"], ["seg"], line)
    return cut_lines.unionByName(standing.withColumns({c: F.col(c).cast(cut_lines.schema[c].dataType) for c in ("part", "n_parts")}))


#: A piece of a line counts as covered if at most this part of its length is not.
SLACK = 1e-9


def _disc(px: Column, py: Column, d: float) -> tuple[Column, Column]:
    """Where a piece ``x1`` … ``y2`` is within ``d`` of a point: the least and largest t in [0, 1]; least > largest if nowhere."""
    ax, ay = F.col("x1") - px, F.col("y1") - py
    bx, by = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square, half, rest = bx * bx + by * by, ax * bx + ay * by, ax * ax + ay * ay - d * d
    # from the cross product, not from half ** 2 - square * rest, which cancels far from the point
    cross = ax * by - ay * bx
    root = square * d * d - cross * cross
    reach = F.sqrt(F.greatest(root, F.lit(0.0)))
    never = F.when(square == 0, rest > 0).otherwise(root < 0)
    low = F.when(square == 0, 0.0).otherwise((-half - reach) / F.nullif(square, F.lit(0.0)))
    high = F.when(square == 0, 1.0).otherwise((-half + reach) / F.nullif(square, F.lit(0.0)))
    return F.when(never, 2.0).otherwise(F.greatest(low, F.lit(0.0))), F.when(never, -1.0).otherwise(F.least(high, F.lit(1.0)))


def _slab(bounds: Sequence[tuple[Column, Column]]) -> tuple[Column, Column]:
    """The t in [0, 1] at which every ``at + t * step`` is 0 or more."""
    lows, highs = [F.lit(0.0)], [F.lit(1.0)]
    for at, step in bounds:
        turn = -at / F.nullif(step, F.lit(0.0))
        lows.append(F.when(step > 0, turn).when((step == 0) & (at < 0), 2.0).otherwise(0.0))
        highs.append(F.when(step < 0, turn).when((step == 0) & (at < 0), -1.0).otherwise(1.0))
    return F.greatest(*lows), F.least(*highs)


def _corridor(d: float) -> tuple[Column, Column]:
    """Where a piece ``x1`` … ``y2`` is within ``d`` of the network piece ``nx1`` … ``ny2``.

    Distance to a straight piece is a convex function along a line, so this is one interval: that of the discs around both ends
    and the strip between them.
    """
    nx, ny = F.col("nx2") - F.col("nx1"), F.col("ny2") - F.col("ny1")
    length = F.hypot(nx, ny)
    ax, ay = F.col("x1") - F.col("nx1"), F.col("y1") - F.col("ny1")
    bx, by = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along, along_step = ax * nx + ay * ny, bx * nx + by * ny
    beside, beside_step = ax * ny - ay * nx, bx * ny - by * nx
    strip = _slab([
        (along, along_step), (length * length - along, -along_step),
        (length * d - beside, -beside_step), (length * d + beside, beside_step),
    ])
    parts = [_disc(F.col("nx1"), F.col("ny1"), d), _disc(F.col("nx2"), F.col("ny2"), d), strip]
    met = [low <= high for low, high in parts]
    return (
        F.least(*[F.when(m, low) for m, (low, _) in zip(met, parts)]),
        F.greatest(*[F.when(m, high) for m, (_, high) in zip(met, parts)]),
    )


def _pieces(df: DataFrame, line: str, line_id: str) -> DataFrame:
    """The straight pieces of lines; a line (or part) of one point is a piece of no length."""
    parts = line_parts(df.select(line_id, line), line) if G.depth(df, line) == 2 else df.select(line_id, line)
    point = F.col(line)[0]
    dots = parts.filter(F.size(line) == 1).select(
        line_id, F.lit(-1).alias("seg"), *[point[c].alias(c + k) for k in "12" for c in "xy"]
    )
    return segments(df, line, [line_id]).select(line_id, "seg", *ENDS).unionByName(dots.select(line_id, "seg", *ENDS))


#: While a part of a line has more network pieces than this near its cell, on average, cells are cut finer, at most so often.
FEW_PIECES = 8
FINER, MOST_FINER = 4, 4


def _inside_cell(cell: float) -> tuple[Column, Column]:
    """From and to which t a piece lies in its cell ``cx``, ``cy``, which is a little larger than it is so that rounding loses no part."""
    more = cell * SLACK
    bx, by = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    west, south = F.col("cx") * cell, F.col("cy") * cell
    return _slab([
        (F.col("x1") - west + more, bx), (west + cell + more - F.col("x1"), -bx),
        (F.col("y1") - south + more, by), (south + cell + more - F.col("y1"), -by),
    ])


def _parts(placed: DataFrame, cell: float) -> DataFrame:
    """Pieces by cell with the part that lies there, from ``enter`` to ``leave``."""
    enter, leave = _inside_cell(cell)
    still = (F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))
    home = (F.col("cx") == _index(F.col("x1"), cell)) & (F.col("cy") == _index(F.col("y1"), cell))
    there = F.when(still, home).otherwise(F.col("enter") < F.col("leave"))
    return placed.withColumns({"enter": enter, "leave": leave}).filter(there)


def _near_cells(placed: DataFrame, cell: float, d: float) -> DataFrame:
    """Network pieces by cell that come within ``d`` of a point in it; ``covers`` tells that they do so of all points in it."""
    away = G.point_segment((F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell, *[F.col("n" + c) for c in ENDS])
    corner = cell * (math.sqrt(0.5) + 4 * SLACK)
    return placed.withColumn("away", away).filter(F.col("away") <= d * (1 + SLACK) + corner).select(
        *["n" + c for c in ENDS], "cx", "cy", (F.col("away") <= d - corner).alias("covers")
    )


def _children(df: DataFrame) -> DataFrame:
    """Rows by cell in each of the FINER * FINER cells that theirs is cut into."""
    steps = F.array(*[F.lit(i) for i in range(FINER)])
    by_column = df.withColumn("__i", F.explode(steps)).withColumn("__j", F.explode(steps))
    return by_column.withColumns({"cx": F.col("cx") * FINER + F.col("__i"), "cy": F.col("cy") * FINER + F.col("__j")}).drop("__i", "__j")


def lines_within(
    df: DataFrame, line: str, line_id: str, network: DataFrame, d: float, cell: float | None = None
) -> DataFrame:
    """Lines all of whose points are within ``d`` of the network segments.

    Each straight piece is cut at grid cells. Its part in a cell is within where one network piece comes that near to the
    whole cell, and outside where none comes near to any of it, which settles nearly all cells of a dense network without
    meeting its pieces. Cells at the edge of the corridor are cut finer until few network pieces are near them. There these
    give intervals of the piece that are within ``d`` of them, and one pass in the order of their starts finds what none
    covers. The test is exact but for rounding (``SLACK`` of a piece's length and of ``d``). A line of no length is tested
    where it stands; NULL lines and lines without points are not within. Without a network no line is.
    """
    cell = cell or d / 2 or 1.0
    reach = d * (1 + SLACK)
    parts = _parts(segment_cells(_pieces(df, line, line_id), cell), cell)
    nodes = segment_cells(network.select(*ENDS).distinct(), cell, pad=reach + 2 * cell * SLACK)
    index = materialize(_near_cells(nodes.withColumnsRenamed({c: "n" + c for c in ENDS}), cell, d), "corridor-cells")
    outside = []
    for finer in range(MOST_FINER + 1):
        cells = index.groupBy("cx", "cy").agg(F.max("covers").alias("covered"), F.count(F.lit(1)).alias("held"))
        seen = materialize(
            cell_join(parts.withColumns({"at_x": F.col("cx"), "at_y": F.col("cy")}), cells, "left")
            .filter(~F.coalesce("covered", F.lit(False))).drop("covered").withColumnsRenamed({"at_x": "cx", "at_y": "cy"}),
            "corridor-parts",
        )
        outside.append(seen.filter("held is null").select(F.col(line_id).alias("__out")).distinct())
        # a line with a part outside is settled
        parts = seen.filter("held is not null").join(outside[-1], F.col(line_id).eqNullSafe(F.col("__out")), "left_anti")
        n, held = parts.agg(F.count(F.lit(1)), F.sum("held")).first()
        if n == 0 or held <= FEW_PIECES * n or finer == MOST_FINER:
            break
        cell /= FINER
        open_cells = parts.select(F.col("cx").alias("ox"), F.col("cy").alias("oy")).distinct()
        index = index.join(open_cells, (F.col("cx") == F.col("ox")) & (F.col("cy") == F.col("oy"))).drop("ox", "oy", "covers")
        index = materialize(_near_cells(_children(index), cell, d), "corridor-cells")
        parts = _parts(_children(parts.drop("enter", "leave", "held")), cell)
    if n:
        outside.append(_uncovered(parts.drop("held"), index.drop("covers"), line_id, reach))
    points = F.flatten(line) if G.depth(df, line) == 2 else F.col(line)
    out = reduce(DataFrame.unionByName, outside).distinct()
    return df.filter(F.size(points) > 0).join(out, F.col(line_id).eqNullSafe(F.col("__out")), "left_anti")


def _uncovered(parts: DataFrame, index: DataFrame, line_id: str, reach: float) -> DataFrame:
    """``__out``, the lines of ``parts`` with a stretch that no network piece of its cell is within ``reach`` of."""
    placed = parts.withColumn("part", F.struct("seg", *ENDS, "cx", "cy"))
    met = cell_join(placed, index, "left")
    # a part whose cell has no network is met by nothing
    low, high = (F.when(F.col("nx1").isNotNull(), c) for c in _corridor(reach))
    spans = met.select(line_id, "part", "enter", "leave", low.alias("low"), high.alias("high"))
    before = Window.partitionBy(line_id, "part").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("enter"), F.coalesce(F.max("high").over(before), F.col("enter")))
    gap = F.when(F.col("low").isNotNull(), F.least("low", "leave") - F.col("reached") > SLACK)
    return (
        spans.withColumn("reached", reached).groupBy(line_id, "part")
        .agg(F.coalesce(F.max(gap), F.lit(False)).alias("gap"), (F.first("leave") - F.max("high")).alias("open"))
        .filter(F.col("gap") | F.col("open").isNull() | (F.col("open") > SLACK))
        .select(F.col(line_id).alias("__out")).distinct()
    )


def _sorted_ends(edges: DataFrame) -> DataFrame:
    """Edges with the smaller end first."""
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    swap = (x1 > x2) | ((x1 == x2) & (y1 > y2))
    return edges.select(
        F.when(swap, x2).otherwise(x1).alias("x1"), F.when(swap, y2).otherwise(y1).alias("y1"),
        F.when(swap, x1).otherwise(x2).alias("x2"), F.when(swap, y1).otherwise(y2).alias("y2"),
    )


def _place(s: Sequence[Column], x: Column, y: Column) -> Column:
    """Where on a segment, from 0 to 1, a point of its line lies, by its longer direction."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    return F.when(F.abs(dx) >= F.abs(dy), (x - s[0]) / F.nullif(dx, F.lit(0.0))).otherwise((y - s[1]) / F.nullif(dy, F.lit(0.0)))


def clip_lines(
    df: DataFrame, line: str, line_id: str, polys: DataFrame, rings: str, poly_id: str, cell: float | None = None
) -> DataFrame:
    """Per line and area the parts of the line inside: ``lines`` (array of lines, as it may leave and re-enter).

    Which side a point lies on is decided exactly. Where a line runs through a vertex, all edges there cut it at the vertex's
    own place, and an edge that two areas share cuts it in one place for both, so no sliver is left between two cuts.
    """
    cell = cell or auto_cell(polys, rings)
    segs = segments(df, line, [line_id])
    edges = _sorted_ends(polygon_edges(polys, rings, [])).distinct()
    edge_cells = materialize(segment_cells(edges, cell, pad=cell * EDGE).withColumnsRenamed({c: "e_" + c for c in ENDS}), "edge-cells")
    a = [F.col(c) for c in ENDS]
    b = [F.col("e_" + c) for c in ENDS]
    near = cell_join(
        materialize(segment_cells(segs, cell), "line-cells"), edge_cells, "inner", ~G.surely_beside(a, b) & ~G.surely_beside(b, a)
    )
    signs = G.orient_signs([[*b, a[0], a[1]], [*b, a[2], a[3]], [*a, b[0], b[1]], [*a, b[2], b[3]]])
    end1, end2 = F.col("__signs")[2], F.col("__signs")[3]
    meets = ((F.col("__signs")[0] > 0) != (F.col("__signs")[1] > 0)) & (end1 * end2 <= 0)
    hits = materialize(near.withColumn("__signs", signs), "line-hits").filter(meets)
    side1, side2 = G.orient(*b, a[0], a[1]), G.orient(*b, a[2], a[3])
    between = F.coalesce(side1 / F.nullif(side1 - side2, F.lit(0.0)), F.lit(0.0))
    at = F.when(end1 == 0, _place(a, b[0], b[1])).when(end2 == 0, _place(a, b[2], b[3])).otherwise(between)
    cuts = hits.groupBy(F.col(line_id).alias("__k"), F.col("seg").alias("__s")).agg(
        F.array_sort(F.collect_set(F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0)))).alias("__cuts")
    )
    stops = F.concat(F.array(F.lit(0.0)), F.coalesce(F.col("__cuts"), F.array().cast("array<double>")), F.array(F.lit(1.0)))
    spans = segs.join(cuts, (F.col(line_id) == F.col("__k")) & (F.col("seg") == F.col("__s")), "left").withColumn(
        "__stops", stops
    )
    n = F.size("__stops") - 1
    parts = spans.select(
        line_id, "seg", *ENDS,
        F.explode(F.zip_with(F.slice("__stops", F.lit(1), n), F.slice("__stops", F.lit(2), n),
                             lambda s, e: F.struct(s.alias("t0"), e.alias("t1")))).alias("t"),
    ).select(line_id, "seg", "t.*", *ENDS).filter(F.col("t1") > F.col("t0"))
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    t0, t1 = F.col("t0"), F.col("t1")
    cut = parts.select(
        line_id, "seg", "t0", "t1",
        (x1 + t0 * (x2 - x1)).alias("x1"), (y1 + t0 * (y2 - y1)).alias("y1"),
        (x1 + t1 * (x2 - x1)).alias("x2"), (y1 + t1 * (y2 - y1)).alias("y2"),
        (x1 + (t0 + t1) / 2 * (x2 - x1)).alias("mx"), (y1 + (t0 + t1) / 2 * (y2 - y1)).alias("my"),
    )
    inside = points_in_area(cut, polys.select(poly_id, rings), rings, cell, "mx", "my")
    along = Window.partitionBy(line_id, poly_id).orderBy("seg", "t0")
    follows = ((F.col("seg") == F.lag("seg").over(along)) & (F.col("t0") == F.lag("t1").over(along))) | (
        (F.col("seg") == F.lag("seg").over(along) + 1) & (F.col("t0") == 0) & (F.lag("t1").over(along) == 1)
    )
    runs = inside.withColumn("__new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn(
        "__run", F.sum("__new").over(along)
    )
    joined = _regroup(runs, [line_id, poly_id, "__run"], ["seg", "t0"], "__line")
    return joined.groupBy(line_id, poly_id).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__run", "__line"))), lambda r: r["__line"]).alias("lines")
    )


# ---- polygons ------------------------------------------------------------------------------------------


def dissolve_edges(polys: DataFrame, rings: str) -> DataFrame:
    """Outline of a clean coverage: the edges that belong to one area only, ends in sorted order."""
    edges = _sorted_ends(polygon_edges(polys, rings, []))
    return edges.groupBy(*ENDS).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


def _level(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Exponent of the smallest power of two that is not shorter than the edge."""
    return F.ceil(F.log2(F.greatest(F.abs(x2 - x1), F.abs(y2 - y1))))


def _box_cells(df: DataFrame, size: Column) -> DataFrame:
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    return df.withColumn(
        "cx", F.explode(F.sequence(F.floor(F.least(x1, x2) / size), F.floor(F.greatest(x1, x2) / size)))
    ).withColumn("cy", F.explode(F.sequence(F.floor(F.least(y1, y2) / size), F.floor(F.greatest(y1, y2) / size))))


def validity(df: DataFrame, rings: str, poly_id: str) -> DataFrame:
    """Per polygon: are its rings sound, how often do its own edges cross, and is it valid.

    Not valid are rings that are not sound, edges that cross or run along each other (spikes too), edges of one ring
    that touch without being neighbours, and holes outside their shell. A hole may touch its shell at a point.

    Every edge is filed in the cells of a grid as coarse as the edge is long, and looks up the cells it lies in
    on its own and all coarser grids of its polygon. So a stretch drawn in great detail does not crowd a cell.
    """
    parts = F.col(rings) if G.depth(df, rings) == 3 else F.array(rings)
    each = F.flatten(parts)
    finite = "abs(x1 + x2 + y1 + y2) < double('inf')"
    # repeated points make no edge, so neighbours have consecutive numbers
    drawn = F.transform(each, lambda r: F.filter(G.pairs(r), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"])))
    edges = materialize(
        df.select(F.col(poly_id).alias("__pid"), F.posexplode(drawn).alias("ring", "r"))
        .select("__pid", "ring", F.size("r").alias("held"), F.posexplode("r").alias("seg", "s"))
        .select("__pid", "ring", "held", "seg", "s.*").withColumn("__lv", _level(*[F.col(c) for c in ENDS])).filter(finite),
        "polygon-edges",
    )
    levels = edges.groupBy(F.col("__pid").alias("__lp")).agg(F.collect_set("__lv").alias("__levels"))
    filed = _box_cells(edges, F.pow(F.lit(2.0), F.col("__lv"))).select(
        F.col("__pid").alias("__oid"), F.col("ring").alias("__oring"), F.col("seg").alias("__oseg"),
        F.col("__lv").alias("__olv"), F.col("cx").alias("__ocx"), F.col("cy").alias("__ocy"),
        *[F.col(c).alias("__o" + c) for c in ENDS],
    )
    looking = _box_cells(
        edges.join(levels, F.col("__pid") == F.col("__lp"))
        .withColumn("__at", F.explode(F.filter("__levels", lambda v: v >= F.col("__lv")))),
        F.pow(F.lit(2.0), F.col("__at")),
    )
    a, b = [F.col(c) for c in ENDS], [F.col("__o" + c) for c in ENDS]
    crossing = G.segments_cross(a, b)
    apart = F.abs(F.col("seg") - F.col("__oseg"))
    neighbours = (apart == 1) | (apart == F.col("held") - 1)
    same_ring = F.col("ring") == F.col("__oring")
    wrong = crossing | G.segments_overlap(a, b) | (same_ring & ~neighbours & G.segments_touch(a, b))
    earlier = (F.col("ring") < F.col("__oring")) | (same_ring & (F.col("seg") < F.col("__oseg")))
    met = (
        looking.join(
            filed,
            (F.col("__pid") == F.col("__oid")) & (F.col("__at") == F.col("__olv"))
            & (F.col("cx") == F.col("__ocx")) & (F.col("cy") == F.col("__ocy"))
            & ((F.col("__lv") < F.col("__olv")) | earlier) & wrong,
        )
        .select(F.col("__pid").alias("__id"), "ring", "seg", "__oring", "__oseg", crossing.alias("__crosses")).distinct()
        .groupBy("__id").agg(F.count_if("__crosses").alias("__n"), F.count(F.lit(1)).alias("__wrong"))
    )

    def holes_inside(part: Column) -> Column:
        def inside(hole: Column) -> Column:
            return G.let(G.point_on_surface(F.array(hole)), lambda p: G.contains(F.array(part[0]), p["x"], p["y"]))

        return F.forall(F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))), inside)

    sound = F.coalesce(F.forall(each, G.is_ring_valid) & (F.size(each) > 0), F.lit(False))
    held = df.select(
        poly_id, sound.alias("rings_sound"), F.when(sound, F.coalesce(F.forall(parts, holes_inside), F.lit(False))).alias("__inside")
    )
    out = held.join(met, F.col(poly_id) == F.col("__id"), "left").drop("__id")
    valid = F.col("rings_sound") & F.coalesce("__inside", F.lit(False)) & (F.coalesce("__wrong", F.lit(0)) == 0)
    return out.select(poly_id, "rings_sound", F.coalesce("__n", F.lit(0)).alias("self_crossings"), valid.alias("valid"))


def expanded_extent(df: DataFrame, points: str, d: float) -> DataFrame:
    """One row: the box around all points of a line column, grown by ``d`` on each side."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return df.agg(
        (F.min(F.array_min(xs)) - d).alias("xmin"), (F.min(F.array_min(ys)) - d).alias("ymin"),
        (F.max(F.array_max(xs)) + d).alias("xmax"), (F.max(F.array_max(ys)) + d).alias("ymax"),
    )
