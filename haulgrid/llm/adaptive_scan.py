"""Approximate nearest neighbours by inner product: inverted lists and an adaptive scan of dimensions.

Vectors get one more component so that all have one norm; the largest inner product is then the smallest distance. They are
rotated at random and put into the list of the nearest of some centres. Within a probed list a query's distances grow column block by
column block: after d of D rotated dimensions the partial distance, scaled by D / d, is an estimate whose error falls with
the square root of d. A candidate whose estimate exceeds the query's bound by more than that error allows is
abandoned (a hypothesis test per block). The bound is the distance of the k-th best in the query's nearest lists, which
are scanned first. Survivors are scored exactly, on the original vectors in double precision.

Equal vectors are one candidate with its smallest ids, and one query, so copies add no work. Lists travel as blocks
of bounded size and so do the queries that probe them: a list with a large part of all vectors is many rows. What travels
is large blocks of queries, as every one of them brings a whole block of candidates along; what is tested at once is a tile
of few queries, by matrix products while many of its pairs are alive and pair by pair afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import chosen_by_hash, map_arrow, write_table

NEAREST = 20
#: Vectors that centres are fitted on, and centres, at most. Every vector is in a list, whatever their number.
SAMPLE = 20_000
MOST_LISTS = 4096
#: Share of the lists that a query probes, and how many at least.
PROBE_SHARE = 0.7
LEAST_PROBES = 16
#: Candidates of a block, queries that travel together to a list, and queries that are tested at once.
BLOCK, QUERIES, QUERY_BLOCK = 512, 1024, 64
COLUMNS = 16
#: Pairs are met one by one when fewer than one in so many of a tile are alive.
SPARSE = 16
#: Errors of the estimate that a candidate's distance may exceed the bound by.
TRUST = 2.1


class Index:
    """Rotation and centres for vectors with one component added; ``radius`` is the norm that all are given."""

    def __init__(self, sample: np.ndarray, radius: float, lists: int, seed: int = 5):
        random = np.random.default_rng(seed)
        self.radius = radius
        self.rotation = np.linalg.qr(random.standard_normal((sample.shape[1] + 1,) * 2))[0]
        x = self.rotate(sample)
        self.centres = x[np.sort(random.choice(len(x), min(lists, len(x)), replace=False))].copy()
        for _ in range(8):
            own = self.order(x, 1)[:, 0]
            sums, n = np.zeros_like(self.centres), np.bincount(own, minlength=len(self.centres))
            np.add.at(sums, own, x)
            self.centres[n > 0] = sums[n > 0] / n[n > 0, None]

    def rotate(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x.astype(float)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.radius**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, more]) @ self.rotation

    def order(self, rotated: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest centres of each vector, nearest first."""
        far = (self.centres**2).sum(axis=1) - 2 * rotated @ self.centres.T
        return far.argmin(axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lists(index: Index):
    """Pieces of lists, as a batch has them: list, ids (of copies), vectors and rotated vectors as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _matrix(batch.column("v")), batch.column("ids").to_pylist()
            turned = index.rotate(x)
            own = index.order(turned, 1)[:, 0]
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.diff(own[order])) + 1
            parts = [p[i : i + BLOCK] for p in np.split(order, cuts) for i in range(0, len(p), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(own[p[0]]) for p in parts], pa.int32()),
                 pa.array([[ids[i] for i in p] for p in parts], pa.list_(pa.list_(pa.int64()))),
                 pa.array([x[p].astype("<f4").tobytes() for p in parts], pa.binary()),
                 pa.array([turned[p].astype("<f4").tobytes() for p in parts], pa.binary())],
                ["list", "ids", "plain", "turned"],
            )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of their lists, joined to blocks of at most ``BLOCK`` candidates, but for a batch's last ones."""
    for batch in batches:
        lists, ids = batch.column("list").to_numpy(), batch.column("ids")
        cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            own, plain, turned = ids.slice(a, b - a).flatten(), *(
                b"".join(batch.column(c).slice(a, b - a).to_pylist()) for c in ("plain", "turned")
            )
            n = len(own)
            starts = range(0, n, BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lists[a]] * len(starts), pa.int32()),
                 pa.ListArray.from_arrays(pa.array([*starts, n], pa.int32()), own),
                 *(pa.array([v[i * w : (i + BLOCK) * w] for i in starts], pa.binary())
                   for v in (plain, turned) for w in [len(v) // n])],
                ["list", "ids", "plain", "turned"],
            )


def _probes(index: Index, sizes: np.ndarray, probes: int, enough: int, first: bool):
    """Blocks of queries by list: the nearest lists with ``enough`` vectors, or the other ones up to ``probes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, QUERIES) for b in batches for i in range(0, b.num_rows, QUERIES)):
            x, keys = _matrix(batch.column("v")), batch.column("key").to_numpy(zero_copy_only=False)
            bound = batch.column("bound").to_numpy(zero_copy_only=False)
            near = index.order(index.rotate(x, query=True), len(sizes))
            before = np.cumsum(sizes[near], axis=1) - sizes[near]
            head = before < enough
            wanted = head if first else ~head & (np.arange(len(sizes)) < probes)
            rows, at = np.nonzero(wanted)
            lists = near[rows, at]
            order = np.argsort(lists, kind="stable")
            cuts = np.flatnonzero(np.diff(lists[order])) + 1
            groups = [p for p in np.split(order, cuts) if len(p)]
            for i in range(0, len(groups), QUERY_BLOCK):  # not all lists at once: each may be wanted by all queries
                names, parts = zip(*[(int(lists[g[0]]), rows[g]) for g in groups[i : i + QUERY_BLOCK]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int32()), pa.array([keys[p] for p in parts], pa.list_(pa.int64())),
                     pa.array([x[p].astype("<f4").tobytes() for p in parts], pa.binary()),
                     pa.array([bound[p].astype("<f8").tobytes() for p in parts], pa.binary())],
                    ["list", "keys", "queries", "bounds"],
                )

    return run


def survivors(
    queries: np.ndarray, turned: np.ndarray, bounds: np.ndarray, trust: float = TRUST
) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) numbers of the pairs that no test abandons; ``bounds`` are squared distances, one a query.

    While many pairs are alive, a block of columns is one matrix product over all pairs; later ones meet only those still alive.
    """
    width = turned.shape[1]
    rows = cols = total = None
    every, own = np.zeros((len(queries), len(turned))), np.zeros(len(queries))  # distances are their sum
    alive = np.ones(every.shape, bool)
    for d in range(0, width, COLUMNS):
        seen = min(d + COLUMNS, width)
        x, q = turned[:, d:seen], queries[:, d:seen]
        slack = (1 + trust / np.sqrt(seen)) ** 2 if seen < width else 1 + 1e-5
        limit = (bounds * slack + 1e-6) * (seen / width)
        if rows is None:
            every += (x * x).sum(axis=1) - (2 * q) @ x.T
            own += (q * q).sum(axis=1)
            alive &= every <= (limit - own)[:, None]
            if seen == width or np.count_nonzero(alive) * SPARSE < alive.size:
                rows, cols = np.nonzero(alive)
                total = every[rows, cols] + own[rows]
            continue
        gap = x[cols] - q[rows]
        total = total + np.einsum("ij,ij->i", gap, gap)
        keep = total <= limit[rows]
        rows, cols, total = rows[keep], cols[keep], total[keep]
    return rows, cols


def best(queries: np.ndarray, plain: np.ndarray, rows: np.ndarray, cols: np.ndarray, least: np.ndarray, k: int):
    """(query, candidate) numbers and exact scores of each query's ``k`` best of the given pairs, ties to the smaller ``least``."""
    if len(rows) > 2 * k * len(queries):
        # a product over all pairs tells which cannot be among them, but for its rounding
        every = np.full((len(queries), len(plain)), -np.inf)
        every[rows, cols] = (queries @ plain.T)[rows, cols]
        if k < len(plain):
            cut = np.partition(every, len(plain) - k, axis=1)[:, len(plain) - k]
            room = 1e-12 * np.sqrt((queries * queries).sum(axis=1) * (plain * plain).sum(axis=1).max())
            keep = every[rows, cols] >= (cut - room)[rows]
            rows, cols = rows[keep], cols[keep]
    scores = np.einsum("ij,ij->i", plain[cols], queries[rows])
    order = np.lexsort((least[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], cols[first], scores[first]


def _scan(index: Index, dims: int, k: int):
    out = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, keys = batch.column("ids")[at].values, batch.column("keys")[at].values.to_numpy(zero_copy_only=False)
                plain, turned, queries = (
                    np.frombuffer(batch.column(c)[at].as_buffer(), "<f4").reshape(-1, width).astype(float)
                    for c, width in (("plain", dims), ("turned", dims + 1), ("queries", dims))
                )
                bounds, asked = np.frombuffer(batch.column("bounds")[at].as_buffer(), "<f8"), index.rotate(queries, True)
                least, found = pc.list_element(ids, 0).to_numpy(zero_copy_only=False), []
                for i in range(0, len(queries), QUERY_BLOCK):
                    tile = slice(i, i + QUERY_BLOCK)
                    rows, cols, scores = best(queries[tile], plain, *survivors(asked[tile], turned, bounds[tile]), least, k)
                    found.append((rows + i, cols, scores))
                rows, cols, scores = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), ids.take(pa.array(cols)), pa.array(scores)], schema=out)

    return run


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = NEAREST,
    probe_share: float = PROBE_SHARE, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, the id, score): the ``k`` nearest found of each query by inner product, ties to the smaller id.

    Rows without an id, and vectors that are NULL, zero, or hold NULL or non-finite components, take no part; nor do
    vectors with another number of components than most have. A query's candidates are all rows with another id.
    Repeated rows count once. Other columns are not looked at. No vectors: no rows.
    """
    ok = vectors.filter(_usable(F.col(vector)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), is_query.alias("asks")
    )
    schema = f"query_id long, rank int, {id_col} long, score double"
    widths = ok.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if widths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = widths["d"]
    ok = ok.filter(F.size("v") == dims)
    # k + 1 ids of a vector are enough for the k nearest rows of any query, also of one that is among them
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    some = ok.select("id", "v").withColumn("nth", copy).filter(F.col("nth") <= k + 1)
    # the key is written with its row, so it does not change
    distinct = write_table(
        some.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("key", F.monotonically_increasing_id()),
        "distinct",
    )
    asked = write_table(
        ok.filter("asks").select(F.col("id").alias("query_id"), "v").join(distinct.select("v", "key"), "v")
        .select("query_id", "key").distinct(), "asked",
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, radius = distinct.agg(F.count(F.lit(1)), F.max(norm)).first()
    drawn = sorted(distinct.filter(chosen_by_hash(F.xxhash64("v"), sample, n)).select("v").collect())
    lists = min(MOST_LISTS, max(1, round(n**0.5)))
    index = Index(np.array([r[0] for r in drawn], float), radius, lists)
    form = "list int, ids array<array<long>>, plain binary, turned binary"
    # every batch has a few vectors of every list; they are joined, and a list too large for a task is split by the rebalancing
    pieces = map_arrow(distinct.select("v", "ids"), _lists(index), form)
    blocks = write_table(map_arrow(pieces.hint("rebalance", "list").sortWithinPartitions("list"), _blocks, form), "lists")
    sizes = np.zeros(len(index.centres), np.int64)
    for r in blocks.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():
        sizes[r[0]] = r[1]
    probes = max(LEAST_PROBES, int(np.ceil(len(sizes) * probe_share)))
    some_query = asked.select("key").distinct()
    travel = -(-some_query.count() // QUERIES)
    asking = distinct.join(some_query, "key", "left_semi").select("key", "v")
    # the more vectors give the bound, the fewer pass it: about as many of either
    enough = max(4 * (k + 1), int(np.ceil(((k + 1) * n) ** 0.5)))

    def scan(queries: DataFrame, first: bool) -> DataFrame:
        wanted = map_arrow(
            queries.repartition(max(1, travel)), _probes(index, sizes, probes, enough, first),
            "list int, keys array<long>, queries binary, bounds binary",
        )
        # ``wanted`` holds every query once a list; its size would be guessed from the few queries it is made of, and broadcast
        return map_arrow(blocks.join(wanted.hint("merge"), "list"), _scan(index, dims, k + 1), "key long, ids array<long>, score double")

    head = write_table(scan(asking.withColumn("bound", F.lit(float("inf"))), True), "head")
    kth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score")))
    ids = head.select("key", "score", F.explode("ids").alias("id"))
    last = ids.withColumn("nth", kth).filter(F.col("nth") == k + 1).select("key", F.col("score").alias("kth"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    bound = F.coalesce(square + radius * radius - 2 * F.col("kth"), F.lit(float("inf")))
    rest = scan(asking.join(last, "key", "left").select("key", "v", bound.alias("bound")), False)
    every = head.unionByName(rest).select("key", F.explode("ids").alias("id"), "score")
    order = [F.desc("score"), F.asc("id")]
    few = every.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(
        F.col("nth") <= k + 1
    )
    found = asked.join(few.drop("nth"), "key").filter("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.select("query_id", rank.alias("rank"), F.col("id").alias(id_col), "score").filter(F.col("rank") <= k)
