"""Hard negatives by a sort-tile-recursive R-tree over integer vectors.

Tree. Split points of two coordinates, taken from a sample of bounded size, deal all rows into tiles (sort on the first
coordinate, tile, sort each slab on the second); every batch of a tile is then packed by the same rule on the coordinates that
spread most, down to leaves of ``LEAF`` rows. A packed batch is one row, a subtree: its rows in leaf order and the minimum
bounding box of each leaf; the box around those is the subtree's.

Search. Against an anchor q, a box [l, u] holds inner products between q+ l + q- u and q+ u + q- l, coordinate by coordinate (q+ and q-:
the positive and negative parts). Anchors travel in blocks of packed anchors, and each block meets all subtrees, in groups that are
dealt over tasks. There its boxes wait in a queue, largest possible product first; a box is left out for an anchor if its products
lie outside the anchor's score windows or strictly below the anchor's k-th best so far (equal ones stay, as ties go by id). The
search is run twice: for the positives, then for the negatives inside the windows that the positives set.

All products are exact: in double precision where no sum can reach 2^53, in 64-bit integers beyond.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import chosen_by_hash, map_arrow, write_table

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these shares (in percent) of the positive's.
FROM, TO = 30, 90
#: Rows of a leaf, of a subtree and of a block of anchors; subtrees that meet an anchor block in one task.
LEAF, SUBTREE, ASKED, GROUP = 64, 2048, 256, 16
#: Rows that the split points are taken from, at most; tiles and rows of a tile in one task. Every row is in a tile.
SAMPLE, MOST_TILES, TILE_ROWS = 20_000, 1024, 16_384


def quantized(vector: Column) -> Column:
    """Each component x as floor(256 x), x taken as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def tile_order(x: np.ndarray, rows: int) -> np.ndarray:
    """Sort-tile-recursive order: cut into slabs by the coordinate that spreads most, then each slab by its own, to ``rows``."""
    if len(x) <= rows or x.shape[1] == 0:
        return np.arange(len(x))
    leaves = -(-len(x) // rows)
    order = np.argsort(x[:, int(np.argmax(np.ptp(x, axis=0)))], kind="stable")
    slab = -(-leaves // max(2, round(leaves**0.5))) * rows
    parts = [order[i : i + slab] for i in range(0, len(x), slab)]
    return np.concatenate([p[tile_order(x[p], rows)] for p in parts]) if len(parts) > 1 else order


class Tiles:
    """Tile numbers from split points of the two coordinates that vary most in a sample."""

    def __init__(self, sample: np.ndarray, tiles: int):
        self.first = self.second = 0
        self.slabs, self.cuts = np.empty(0), [np.empty(0)]
        if tiles < 2 or not len(sample) or sample.shape[1] == 0:
            return
        spread = np.argsort(-sample.std(axis=0), kind="stable")
        self.first, self.second = int(spread[0]), int(spread[min(1, len(spread) - 1)])
        side = max(2, round(tiles**0.5))
        share = np.arange(1, side) / side
        self.slabs = np.quantile(sample[:, self.first], share)
        own = np.searchsorted(self.slabs, sample[:, self.first], side="right")
        self.cuts = [
            np.quantile(part[:, self.second], share) if len(part := sample[own == i]) else np.empty(0) for i in range(side)
        ]

    def of(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] == 0:
            return np.zeros(len(x), np.int64)
        slab = np.searchsorted(self.slabs, x[:, self.first], side="right")
        out = np.zeros(len(x), np.int64)
        for i in np.unique(slab):
            at = slab == i
            out[at] = np.searchsorted(self.cuts[i], x[at, self.second], side="right")
        return slab * len(self.cuts) + out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _tiled(tiles: dict[int, Tiles]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                at = tiles[int(d)].of(_matrix(own.column("v"), int(d)))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(at)], [*own.schema.names, "tile"])

    return run


def _packed(rows: int, leaf: int):
    """Subtrees of at most ``rows`` rows: dims, ids, keys and labels, and as bytes the vectors and each leaf's box."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, tile = batch.column("dims").to_numpy(), batch.column("tile").to_numpy()
            # rows come tile by tile; small tiles share a subtree
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d)).take(pa.array(np.argsort(tile[dims == d], kind="stable")))
                x = _matrix(own.column("v"), int(d))
                out = []
                for i in range(0, len(x), rows):
                    part = np.arange(i, min(i + rows, len(x)))
                    part = part[tile_order(x[part], leaf)]
                    starts = np.arange(0, len(part), leaf)
                    box = [f.reduceat(x[part], starts, axis=0) for f in (np.minimum, np.maximum)] if d else [x[part][starts]] * 2
                    out.append([int(d), *[own.column(c).to_numpy()[part] for c in ("id", "row", "label")],
                                *[v.astype("<i8").tobytes() for v in (x[part], *box)]])
                kinds = [pa.int32(), *[pa.list_(pa.int64())] * 3, *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], _TREE)

    return run


_TREE = ["dims", "ids", "rows", "labels", "vectors", "low", "high"]
_TREE_SCHEMA = "dims int, ids array<long>, rows array<long>, labels array<long>, vectors binary, low binary, high binary"


class Subtree:
    """The packed subtree in one row of a batch, as numbers of the given kind."""

    def __init__(self, batch: pa.RecordBatch, at: int, kind, leaf: int, prefix: str = ""):
        self.leaf = leaf
        self.ids, self.rows, self.labels = (
            batch.column(prefix + c)[at].values.to_numpy() for c in ("ids", "rows", "labels")
        )
        dims, leaves = batch.column("dims")[at].as_py(), -(-len(self.ids) // leaf)
        self.vectors, self.low, self.high = (
            np.frombuffer(batch.column(prefix + c)[at].as_py(), "<i8").reshape(n, dims).astype(kind)
            for c, n in (("vectors", len(self.ids)), ("low", leaves), ("high", leaves))
        )

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest inner product each leaf's box allows, anchors x leaves."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


class Search:
    """The best rows of a block of anchors in each of their score windows, subtree after subtree.

    ``windows`` has one row (anchor number, least, most score) each; ``same`` asks for rows of the anchor's label, else of others.
    """

    def __init__(self, anchors: Subtree, windows: np.ndarray, k: int, same: bool):
        self.anchors, self.windows, self.k, self.same = anchors, windows, k, same
        empty = np.empty(0, np.int64)
        self.best = [(empty, empty, empty) for _ in windows]
        self.kth = np.full(len(windows), np.iinfo(np.int64).min)
        self.visited, self.name = 0, None

    def add(self, tree: Subtree) -> None:
        who = self.windows[:, 0]
        least, most = tree.intervals(self.anchors.vectors)
        least, most = least[who], most[who]

        def alive(boxes):
            return (
                (most[:, boxes] >= np.maximum(self.windows[:, 1], self.kth)[:, None])
                & (least[:, boxes] <= self.windows[:, 2][:, None])
            )

        wanted = alive(slice(None))
        queue = [(-most[wanted[:, i], i].max(), i) for i in np.flatnonzero(wanted.any(axis=0)).tolist()]
        heapq.heapify(queue)
        while queue:
            _, i = heapq.heappop(queue)
            asked = np.flatnonzero(alive([i])[:, 0])
            if len(asked):
                self.visited += 1
                self._visit(tree, slice(i * tree.leaf, (i + 1) * tree.leaf), asked)

    def _visit(self, tree: Subtree, rows: slice, asked: np.ndarray) -> None:
        numbers, at = np.unique(self.windows[asked, 0], return_inverse=True)
        scores = (self.anchors.vectors[numbers] @ tree.vectors[rows].T).astype(np.int64)
        ids = tree.ids[rows]
        right = (tree.labels[rows] == self.anchors.labels[numbers][:, None]) == self.same
        if self.same:
            right &= ids != self.anchors.ids[numbers][:, None]
        scores, right = scores[at], right[at]
        right &= (scores >= np.maximum(self.windows[asked, 1], self.kth[asked])[:, None]) & (scores <= self.windows[asked, 2][:, None])
        for j in np.flatnonzero(right.any(axis=1)).tolist():
            w, new = asked[j], right[j]
            score, name, row = (np.concatenate(p) for p in zip(self.best[w], (scores[j, new], ids[new], tree.rows[rows][new])))
            order = np.lexsort((row, name, -score))[: self.k]
            self.best[w] = score[order], name[order], row[order]
            if len(order) == self.k:
                self.kth[w] = score[order[-1]]

    def found(self) -> Iterator[tuple]:
        """(window, score, id, row) of all that were kept."""
        for w, (score, name, row) in enumerate(self.best):
            for s, i, r in zip(score.tolist(), name.tolist(), row.tolist()):
                yield w, s, i, r


_FOUND = "anchor long, anchor_row long, positive long, positive_row long, positive_score long, score long, id long, row long"


def _searched(k: int, same: bool, exact_doubles: bool, leaf: int):
    kind = np.float64 if exact_doubles else np.int64
    bounds = np.iinfo(np.int64)

    def results(search: Search, marks: np.ndarray) -> pa.RecordBatch:
        found = np.array(list(search.found()), np.int64).reshape(-1, 4)
        w = found[:, 0]
        who = search.windows[w, 0]
        columns = [search.anchors.ids[who], search.anchors.rows[who], *marks[w].T, *found[:, 1:].T]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of one anchor block follow each other, so its bounds carry over from subtree to subtree
        search = marks = None
        for batch in batches:
            for at in range(batch.num_rows):
                now = batch.column("a_rows")[at].values
                if search is None or not now.equals(search.name):
                    if search is not None:
                        yield results(search, marks)
                    anchors, windows = Subtree(batch, at, kind, leaf, "a_"), batch.column("a_windows")[at].as_py()
                    n = len(anchors.ids)
                    asked = np.frombuffer(windows, "<i8").reshape(-1, 6) if windows is not None else np.column_stack(
                        [np.arange(n), np.full(n, bounds.min), np.full(n, bounds.max), np.zeros((n, 3), np.int64)]
                    )
                    search, marks = Search(anchors, asked[:, :3], k, same), asked[:, 3:]
                    search.name = now
                search.add(Subtree(batch, at, kind, leaf))
        if search is not None:
            yield results(search, marks)

    return run


class _Index:
    def __init__(self, vectors: DataFrame, is_anchor: Column, id_col: str, label: Column, vector: str):
        ok = vectors.filter(usable(F.col(vector)) & F.col(id_col).isNotNull() & label.isNotNull())
        rows = ok.select(
            F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), quantized(F.col(vector)).alias("v"),
            F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        ).withColumn("row", F.xxhash64("id", "label", "v")).withColumn("dims", F.size("v"))
        self.rows = write_table(rows.dropDuplicates(["id", "label", "v"]), "vectors")
        sizes = self.rows.groupBy("dims").agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x)))).alias("most"),
        ).collect() if self._few_lengths() else []
        reach = max([int(r["most"]) ** 2 * r["dims"] for r in sizes], default=0)
        if reach >= 1 << 63:
            raise ValueError("inner products of these vectors do not fit 64 bits")
        self.exact_doubles = reach < 1 << 53
        self.tiles = {}
        for r in sizes:
            drawn = self.rows.filter(F.col("dims") == r["dims"]).filter(
                chosen_by_hash(F.xxhash64("row"), SAMPLE // max(1, len(sizes)), r["n"])
            ).select("v")
            drawn = sorted(x[0] for x in drawn.collect())
            sample = np.array(drawn, float).reshape(len(drawn), r["dims"])
            self.tiles[r["dims"]] = Tiles(sample, min(MOST_TILES, r["n"] // SUBTREE, len(sample) // 16))

    def _few_lengths(self) -> bool:
        lengths = self.rows.select("dims").distinct().limit(1001).count()
        if lengths > 1000:
            raise ValueError("vectors of more than 1,000 different lengths")
        return lengths > 0

    def packed(self, rows: DataFrame, size: int) -> DataFrame:
        """All rows as subtrees of at most ``size`` rows."""
        tiled = map_arrow(rows.select("id", "row", "label", "v", "dims"), _tiled(self.tiles),
                          "id long, row long, label long, v array<long>, dims int, tile long")
        # a tile with many rows, also of equal vectors, is dealt over several tasks
        held = tiled.groupBy("dims", "tile").agg(F.count(F.lit(1)).alias("n"))
        parts = F.ceil(F.col("n") / TILE_ROWS).cast("int")
        dealt = tiled.join(F.broadcast(held.select(F.col("dims").alias("d"), F.col("tile").alias("t"), parts.alias("parts"))),
                           (F.col("dims") == F.col("d")) & (F.col("tile") == F.col("t")))
        dealt = dealt.withColumn("part", F.pmod("row", "parts")).drop("d", "t", "parts")
        ordered = dealt.repartition("dims", "tile", "part").sortWithinPartitions("dims", "tile", "part")
        return map_arrow(ordered.drop("part"), _packed(size, LEAF), _TREE_SCHEMA)

    def search(self, asked: DataFrame, trees: DataFrame, k: int, same: bool) -> DataFrame:
        """Every block of ``asked`` (a subtree, with windows) against all subtrees of its length."""
        groups = max(1, -(-trees.count() // GROUP))
        mine = trees.withColumn("group", F.pmod(F.xxhash64("rows"), F.lit(groups)).cast("int"))
        blocks = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        blocks = blocks.select([F.col(c).alias("a_" + c) for c in blocks.columns])
        met = blocks.join(mine.hint("merge"), (F.col("a_dims") == F.col("dims")) & (F.col("a_group") == F.col("group")))
        return map_arrow(met.drop("group", "a_group", "a_dims").withColumn("a_dims", F.col("dims")),
                         _searched(k, same, self.exact_doubles, LEAF), _FOUND)


def _windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor blocks with the windows of their positives: (anchor number, least, most, id, row, score) each, as bytes."""
    for batch in batches:
        out = batch.drop_columns(["positives"])
        windows = []
        for ids, found in zip(batch.column("ids").to_pylist(), batch.column("positives").to_pylist()):
            own = []
            for p in found:
                s = p["score"]
                own.append((p["at"], -(-FROM * s // 100), TO * s // 100, p["id"], p["row"], s))
            windows.append(np.array(own, "<i8").reshape(-1, 6).tobytes())
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(windows, pa.binary())], [*out.schema.names, "windows"])


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: Column | str = "label", vector: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    Scores are inner products of floor(256 x). Positives are the anchor's first 5 rows of its label with another id, by score and
    then smaller id; negatives the first 10 rows of other labels with a score between 30 % and 90 % of the positive's (none
    if that is below zero). Rows with a NULL id or label, a NULL vector or NULL or non-finite components take no part;
    vectors of another length than the anchor's are not compared with it. Repeated rows count once; rows that share an id but
    differ are rows of their own, not each other's positives. Empty vectors have score zero. Other columns are not
    looked at. No rows: no rows. Inner products beyond 64 bits raise ValueError.
    """
    label = F.col(label) if isinstance(label, str) else label
    index = _Index(vectors, is_anchor, id_col, label, vector)
    trees = write_table(index.packed(index.rows, SUBTREE), "subtrees")
    asked = write_table(index.packed(index.rows.filter("asks"), ASKED), "anchors").withColumn("block", F.xxhash64("ids", "rows"))

    plain = asked.drop("block").withColumn("windows", F.lit(None).cast("binary"))
    near = index.search(plain, trees, POSITIVES, True)
    first = Window.partitionBy("anchor", "anchor_row").orderBy(F.desc("score"), "id", "row")
    positives = near.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= POSITIVES)
    places = asked.select("block", F.posexplode("ids").alias("at", "anchor"), F.col("rows").alias("all")).select(
        "block", "at", "anchor", F.get("all", "at").alias("anchor_row")
    )
    by_block = positives.join(places, ["anchor", "anchor_row"]).groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("at", "nth", "score", "id", "row"))).alias("positives")
    )
    windowed = write_table(
        map_arrow(asked.join(by_block, "block").drop("block"), _windowed, _TREE_SCHEMA + ", windows binary"), "windows"
    )
    far = index.search(windowed, trees, NEGATIVES, False)
    pair = Window.partitionBy("anchor", "anchor_row", "positive", "positive_row").orderBy(F.desc("score"), "id", "row")
    best = far.withColumn("rank", F.row_number().over(pair)).filter(F.col("rank") <= NEGATIVES)
    return best.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
