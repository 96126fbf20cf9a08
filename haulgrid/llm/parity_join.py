"""Jaccard join of word-shingle sets by parity sketches.

A sketch XORs every shingle of a set into it, so shingles that two sets share cancel out and the Hamming distance of two
sketches is at most the size of the symmetric difference. A Jaccard similarity of p % bounds that difference by
D = (100 - p)(|A| + |B|) / (100 + p).

Candidates. Within a family of sizes all sketches are cut into the same segments; a segment holds the XOR of the
64-bit hashes that fall into it. At most D of the segments of two linked sets differ. Each set therefore sends out D + 1
of its non-empty segments, the first ones in an order that all sets share: two linked sets always have one in common
(pigeonhole, as in prefix filtering). The order goes by how many documents the rarest shingle of a segment is in, as far as
that is known, and puts segments with few shingles after those with many, so a passage that many documents share makes few
candidates: it is sent out by documents only that hold little else.

Verification. Candidates pass a parity sketch of single bits (XOR, bit_count) and are then compared exactly. Within a group
of sets with one segment in common, the set that meets most others leads. Each set is first compared with its strongest
leader, and the links give components; then with its other leaders in *other* components; then pairs of a group that are still in
different components are compared one by one: the members outside a group's largest component meet the rest. A group of near
copies costs about one comparison each, and still no link that would join two components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .grouped_pairs import meet
from .tables import drop_table, map_arrow, with_row_key, write_table
from .word_arrays import Words, chunks, mix, window_hashes

WORDS = 5
PERCENT = 75
#: Shingles are counted in blocks of so many; those found in so many sets of a block are reported.
BLOCK = 1 << 21
OFTEN = 4
#: Hash buckets that hold the levels of reported shingles, of the most frequent ones if there are more than ``KNOWN``.
BUCKETS = 1 << 22
KNOWN = 1 << 17
#: A share of all shingles, and a number, from which one is very frequent: it has this level, and one more for each doubling.
FREQUENT = 1 / 16384
FREQUENT_LEAST = 64
VERY = 32
#: A group held together by very frequent shingles is first split into so many parts.
SALTS = 64
#: Sets that meet all of a component do so in blocks of so many.
MEET = 512
#: Up to so many ids of texts that are read again are sent to all tasks.
SENT = 1 << 19
#: Bits of the sketch of a small set; a larger one gets the next power of two of its size.
LEAST_BITS = 2048


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle has are one shingle."""
    for _, data, offsets in chunks(texts):
        found = Words(data, offsets)
        hashes = found.hashes(lower=True)
        for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
            short = b - a < words
            own = window_hashes(hashes[a:b], max(b - a, 1) if short else words)
            own = np.sort(own + np.uint64(b - a) if short else own)
            yield own[np.concatenate([np.ones(min(len(own), 1), bool), own[1:] != own[:-1]])]


def set_id(shingles: np.ndarray) -> int:
    """One 64-bit id for equal sets."""
    total = mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity of the shingles that hash to each bit, as 64-bit words."""
    bits = max(LEAST_BITS, 1 << (len(shingles) - 1).bit_length() if len(shingles) else 1)
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).view(np.int64)


def _band(n: int) -> int:
    return (n.bit_length() - 1) // 2


def families(n: int, percent: int) -> list[tuple[int, int]]:
    """(family, D) under which a set of ``n`` meets its partners: a pair meets in the band of its larger set."""
    band, most = _band(n), 100 * n // percent
    last = 4 ** (band + 1) - 1
    out = [(band, (100 - percent) * (n + min(most, last)) // (100 + percent))]
    if most > last:
        out.append((band + 1, (100 - percent) * (n + most) // (100 + percent)))
    return out


def _segments(shingles: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each non-empty segment begins in the sorted hashes, and its number; small families: one per shingle."""
    if family < 3:
        return np.arange(len(shingles)), np.zeros(len(shingles), np.uint64)
    parts = 4 ** (family + 1) // 2 if family == 3 else 4 ** (family + 1) * 2 // 5
    number = (shingles >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return starts, number[starts]


def lacks_segments(shingles: np.ndarray, percent: int) -> bool:
    """Whether a set has too few non-empty segments for the pigeonhole; next to impossible, but provided for."""
    return any(len(_segments(shingles, f)[0]) <= d for f, d in families(len(shingles), percent))


def often(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are in ``OFTEN`` sets or more, and in how many."""
    shingles = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    slot = (shingles & np.uint64(BLOCK - 1)).astype(np.int64)
    found, count = np.unique(shingles[np.bincount(slot, minlength=BLOCK)[slot] >= OFTEN], return_counts=True)
    return found[count >= OFTEN], count[count >= OFTEN]


def segment_keys(shingles: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The keys a set sends out; the lowest bit tells that all shingles in a segment are very frequent.

    ``levels``, by bucket, tells how frequent shingles are; any will do, as long as all sets share them.
    """
    own = levels[(shingles >> np.uint64(16)).astype(np.int64) & (BUCKETS - 1)].astype(np.uint64)
    out = []
    for family, difference in families(len(shingles), percent):
        starts, number = _segments(shingles, family)
        value = np.bitwise_xor.reduceat(shingles, starts)
        held = np.concatenate([starts[1:], [len(shingles)]]) - starts
        level = np.minimum.reduceat(own, starts)
        key = mix(value + mix(number + np.uint64(family << 40))) & ~np.uint64(1) | (level >= VERY).astype(np.uint64)
        if len(key) > difference + 1:
            order = level << np.uint64(56) | (255 - np.minimum(held, 255)).astype(np.uint64) << np.uint64(48)
            order |= key >> np.uint64(16)
            key = key[order <= np.partition(order, difference)[difference]]  # with all that are no later than the last one
        out.append(key)
    return np.concatenate(out).view(np.int64)


def _signatures(words: int, percent: int):
    names = ["id", "row", "n_shingles", "set_id", "sketch", "lacks", "shingle", "found"]

    def reported(sets: list[np.ndarray]) -> pa.RecordBatch:
        shingles, count = often(sets)
        no = pa.nulls(len(count), pa.int64())
        return pa.RecordBatch.from_arrays(
            [no, pa.nulls(len(count), pa.string()), no, no, pa.nulls(len(count), pa.list_(pa.int64())),
             pa.nulls(len(count), pa.bool_()), pa.array(shingles.view(np.int64)), pa.array(count)],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, seen = [], 0, set()
        for batch in batches:
            size, ids, sketch, lacks = [], [], [], []
            for shingles in shingle_sets(batch.column("text"), words):
                size.append(len(shingles))
                ids.append(set_id(shingles))
                lacks.append(len(shingles) > 0 and lacks_segments(shingles, percent))
                sketch.append(bit_sketch(shingles))
                if ids[-1] not in seen:
                    seen.add(ids[-1])
                    block.append(shingles)
                    held += len(shingles)
                if held >= BLOCK:
                    yield reported(block)
                    block, held, seen = [], 0, set()
            nothing = pa.nulls(len(size), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(size, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(sketch, pa.list_(pa.int64())), pa.array(lacks, pa.bool_()), nothing, nothing],
                names,
            )
        yield reported(block)

    return run


def _keys(words: int, percent: int, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, seen = [], [], set()
            for shingles in shingle_sets(batch.column("text"), words):
                own = set_id(shingles)
                if len(shingles) and own not in seen:
                    seen.add(own)
                    keys.append(segment_keys(shingles, levels, percent))
                    ids.append(np.full(len(keys[-1]), own, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "set_id"]
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["set_id", "shingles"],
            )

    return run


def _folded(sketch: Column, length: Column) -> Column:
    """A sketch as one of fewer words (both are powers of two): what the shorter one's hash rule would have made."""
    def word(j):
        layers = F.sequence(F.lit(0), (F.size(sketch) / length).cast("int") - 1)
        return F.aggregate(layers, F.lit(0).cast("long"), lambda total, i: total.bitwiseXOR(F.get(sketch, (j + i * length).cast("int"))))

    return F.when(F.size(sketch) == length, sketch).otherwise(F.transform(F.sequence(F.lit(0), length - 1), word))


def _sizes_fit(percent: int, a: str = "a_", b: str = "b_") -> Column:
    """Size bound of two rows with prefixed n_shingles."""
    na, nb = F.col(a + "n_shingles"), F.col(b + "n_shingles")
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _near(percent: int, a: str = "a_", b: str = "b_") -> Column:
    """Size bound and Hamming bound of two rows with prefixed n_shingles and sketch columns."""
    na, nb = F.col(a + "n_shingles"), F.col(b + "n_shingles")
    x, y = F.col(a + "sketch"), F.col(b + "sketch")
    length = F.least(F.size(x), F.size(y))
    differing = F.zip_with(_folded(x, length), _folded(y, length), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    distance = F.aggregate(differing, F.lit(0), lambda total, p: total + p)
    return _sizes_fit(percent, a, b) & (distance * (100 + percent) <= (na + nb) * (100 - percent))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


class _Join:
    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent = docs, words, percent
        rows = write_table(
            map_arrow(
                docs, _signatures(words, percent),
                "id long, row string, n_shingles long, set_id long, sketch array<long>, lacks boolean, shingle long, found long",
            ),
            "signatures",
        )
        self.rows = rows.filter("shingle is null").drop("shingle", "found")
        # a NULL or repeated id fetches more texts than the one that is asked for
        self.ids_repeat = not self.rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        self.classes = write_table(
            self.rows.filter("n_shingles > 0").groupBy("set_id")
            .agg(F.min("id").alias("id"), F.max("lacks").alias("lacks"),
                 *[F.first(c).alias(c) for c in ("n_shingles", "sketch")]),
            "classes",
        )
        self.levels = self._levels(rows.filter("shingle is not null"))

    def _levels(self, reported: DataFrame) -> np.ndarray:
        """By bucket, how frequent shingles are that were found often; the others have 0. They order segments and leave none out."""
        total = self.classes.agg(F.sum("n_shingles")).first()[0] or 0
        share = F.sum("found") / F.lit(max(FREQUENT * total, FREQUENT_LEAST))
        level = F.greatest(F.floor(F.log2(share) + 1e-9) + VERY, F.lit(1)).cast("byte")
        bucket = F.shiftrightunsigned("shingle", 16).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
        counted = write_table(reported.groupBy("shingle").agg(level.alias("level")).select(bucket.alias("bucket"), "level"), "reported")
        least, held = 128, 0
        for at, number in sorted(counted.groupBy("level").count().collect(), reverse=True):
            held += number
            if held > KNOWN:
                break
            least = at
        found = counted.filter(F.col("level") >= least).groupBy("bucket").agg(F.max("level").alias("level")).toArrow()
        levels = np.zeros(BUCKETS, np.uint8)
        levels[found["bucket"].to_numpy()] = found["level"].to_numpy()
        return levels

    def groups(self) -> DataFrame:
        """(key, set_id, held, leader, strength): sets that share a segment with another one, and their group's leader.

        The leader is the member that meets most others in all its groups: of copies of one text that is the text itself or
        one close to it. A group of frequent shingles may hold a large part of all sets; it is looked at in SALTS parts.
        """
        keys = map_arrow(
            self.docs.select("text"), _keys(self.words, self.percent, self.levels), "key long, set_id long"
        )
        salt = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, F.col("set_id") % SALTS).otherwise(0)
        group = Window.partitionBy("key", "salt")
        ranked = keys.withColumn("salt", salt.cast("int")).select(
            "key", "salt", "set_id", F.min("set_id").over(group).alias("least"), F.max("set_id").over(group).alias("most")
        )
        shared = ranked.filter("least < most or key & 1 = 1").select("key", "salt", "set_id").distinct()  # copies send out the same
        members = write_table(shared.select("key", "set_id", F.count(F.lit(1)).over(group).alias("held")), "members")
        degree = members.groupBy("set_id").agg(F.sum("held").alias("degree"))
        first = members.join(degree, "set_id").groupBy("key").agg(F.max(F.struct("degree", "set_id")).alias("h"))
        leaders = first.select("key", F.col("h.set_id").alias("leader"), F.col("h.degree").alias("strength"))
        out = write_table(members.join(leaders, "key"), "groups")
        drop_table(members)
        return out

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and sketches allow, with the other columns they have."""
        side = self.classes.drop("lacks", "id")
        return (
            pairs.join(_prefixed(side, "a_"), F.col("a") == F.col("a_set_id"))
            .join(_prefixed(side, "b_"), F.col("b") == F.col("b_set_id"))
            .filter(_near(self.percent)).select(pairs.columns)
        )

    def linked(self, pairs: DataFrame) -> DataFrame | None:
        """The pairs (u, v) of set ids that are similar enough, compared shingle by shingle; None if there is no pair."""
        pairs = write_table(pairs, "candidates")
        if pairs.isEmpty():
            return None
        needed = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
        ids = self.classes.select("set_id", "id").join(needed, "set_id", "left_semi").select(F.col("id").alias("need"))
        needs = write_table(ids, "needed")
        ids = F.broadcast(needs) if needs.count() <= SENT else needs
        texts = self.docs.join(ids, F.col("id").eqNullSafe(F.col("need")), "left_semi").select("text")
        sets = map_arrow(texts, _sets(self.words), "set_id long, shingles array<long>")
        if self.ids_repeat:
            sets = sets.join(needed, "set_id", "left_semi").dropDuplicates(["set_id"])
        sets = write_table(sets, "sets")
        both = (
            pairs.join(_prefixed(sets, "a_"), F.col("a") == F.col("a_set_id"))
            .join(_prefixed(sets, "b_"), F.col("b") == F.col("b_set_id"))
        )
        shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
        size = F.size("a_shingles") + F.size("b_shingles")
        found = both.filter(shared * 100 >= (size - shared) * self.percent)
        out = write_table(found.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        for table in (sets, pairs, needs):
            drop_table(table)
        return out

    def scarce(self) -> DataFrame:
        """Pairs of the sets with too few segments: they meet all sets of their own and the neighbouring bands."""
        band = F.floor(F.floor(F.log2("n_shingles") + 1e-9) / 2)
        few = self.classes.filter("lacks").withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
        return (
            _prefixed(few, "a_").join(_prefixed(self.classes.withColumn("band", band), "b_"), F.col("a_band") == F.col("b_band"))
            .filter(_near(self.percent) & (F.col("a_set_id") != F.col("b_set_id")))
            .select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b"))
        )

    def components(self) -> DataFrame:
        """(set_id, component) of the sets that are linked with another one, but the smallest of each component."""
        groups = self.groups()
        stars = groups.filter("set_id <> leader").groupBy(F.col("leader").alias("a"), F.col("set_id").alias("b"))
        closest = write_table(self.close(stars.agg(F.max("strength").alias("strength"))), "close")
        single = closest.groupBy("b").agg(F.max(F.struct("strength", "a"))["a"].alias("a")).select("a", "b")
        links = self.linked(single)
        if links is None:
            links = closest.select(F.col("a").alias("u"), F.col("b").alias("v"))  # none
        named = self._named(links)
        more = self.linked(self._apart(closest.select("a", "b"), named).join(single, ["a", "b"], "left_anti"))
        if more is not None:
            links = links.unionByName(more)
            named = self._named(links)

        # what is left: pairs of one group, not in one component yet, of which neither is the leader
        rest = self._left(groups.filter("set_id <> leader and (held > 2 or key & 1 = 1)").select("key", "set_id"), named)
        if not self.rows.filter("lacks").isEmpty():
            rest = rest.unionByName(self.scarce()).distinct()
        more = self.linked(rest)
        drop_table(groups)
        if more is None:
            return named
        return self._named(links.unionByName(more))

    def _left(self, members: DataFrame, named: DataFrame) -> DataFrame:
        """The pairs (a, b) of different components that sizes and sketches allow, of members (key, set_id) of one group.

        In each group the members outside its largest component, the main one, meet the rest. Around a main component are
        its members and those outside of it in its groups. A set that would meet others in these groups so often as there are
        sets around that component meets each of them once instead, in blocks and not by groups.
        """
        own = members.join(named, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        several = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
        mixed = own.join(several.select("key"), "key", "left_semi")
        parts = mixed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        main = parts.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), (F.sum("n") - 1).alias("met"))
        mixed = write_table(mixed.join(main, "key"), "mixed")

        outside = mixed.filter("component <> main").groupBy("set_id", "component", "main").agg(F.sum("met").alias("met"))
        around = outside.groupBy("main").agg(F.count(F.lit(1)).alias("n"))
        size = named.groupBy("component").agg(F.count(F.lit(1)).alias("more"))
        held = around.join(size, F.col("main") == F.col("component"), "left").select(
            "main", (F.col("n") + F.coalesce("more", F.lit(0)) + 1).alias("held")
        )
        outside = write_table(outside.join(held, "main").withColumn("whole", F.col("met") >= F.col("held")).drop("met"), "outside")
        whole, side = outside.filter("whole"), self.classes.drop("lacks", "id")
        wanted = whole.select("main", "held").distinct()
        inside = wanted.select(F.col("main").alias("set_id"), "main", "held").unionByName(
            wanted.join(named, F.col("main") == F.col("component")).select("set_id", "main", "held")
        )
        everyone = inside.withColumns({"component": F.col("main"), "whole": F.lit(False)}).unionByName(
            outside.join(wanted.select("main"), "main", "left_semi")
        )
        once = (F.col("a_component") != F.col("b_component")) & (~F.col("b_whole") | (F.col("a_set_id") < F.col("b_set_id")))
        close = meet(
            whole.join(side, "set_id"), everyone.join(side, "set_id"), ["main"], once & _near(self.percent), "set_id", MEET
        ).select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b"))

        sized = mixed.join(side.select("set_id", "n_shingles"), "set_id")
        some = sized.join(outside.filter("not whole").select("set_id", "main"), ["set_id", "main"], "left_semi")
        apart = (F.col("a_key") == F.col("b_key")) & (F.col("a_component") != F.col("b_component")) & _sizes_fit(self.percent)
        pair = F.least("a_set_id", "b_set_id").alias("a"), F.greatest("a_set_id", "b_set_id").alias("b")
        listed = write_table(_prefixed(some, "a_").join(_prefixed(sized, "b_"), apart).select(*pair).distinct(), "listed")
        found = write_table(close.unionByName(self.close(listed)).distinct(), "left")
        for table in (mixed, outside, listed):
            drop_table(table)
        return found

    def _named(self, links: DataFrame) -> DataFrame:
        return connected_components(links).withColumnRenamed("node", "set_id")

    def _apart(self, pairs: DataFrame, named: DataFrame) -> DataFrame:
        """The pairs (a, b) whose ends are in different components."""
        x = named.select(F.col("set_id").alias("a"), F.col("component").alias("x"))
        y = named.select(F.col("set_id").alias("b"), F.col("component").alias("y"))
        both = pairs.join(x, "a", "left").join(y, "b", "left")
        return both.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, row, n_shingles, set_id, component, component_id) of every row of ``docs`` (id, row, text)."""
    if percent < 75:
        raise ValueError("percent must be 75 or more")
    joined = _Join(docs, words, percent)
    own = joined.classes.select("set_id", "id").join(joined.components(), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id")
    )
    least = own.groupBy("component").agg(F.min("id").alias("component_id"))
    labels = write_table(own.join(least, "component").select("set_id", "component", "component_id"), "labels")
    rows = joined.rows.select("id", "row", "n_shingles", "set_id")
    alone = rows.filter("n_shingles = 0").select("*", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"))
    return rows.filter("n_shingles > 0").join(labels, "set_id").select(alone.columns).unionByName(alone)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles and component_id (the smallest id reachable by links).

    Sets are distinct shingles of ``words`` words with A-Z in lower case; two sets link when their Jaccard similarity is
    at least ``percent`` % (75 or more). A text with fewer words is one shingle. NULL and empty texts have no shingle and
    link with nothing. Rows with a NULL id take part; they get the component's smallest id, or NULL if it has none.
    Repeated rows and repeated ids each give a row. Other columns of ``docs`` are not looked at. No rows: no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.lit(None).cast("string").alias("row"), F.col(text).alias("text")
    )
    return _labelled(rows, words, percent).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs`` that stay when one of each component of near duplicates does.

    It is the row with the smallest id, NULL being the largest; of repeated ids any one, the same in every run. Rows
    without words all stay. Columns are those of ``docs``.
    """
    keyed = with_row_key(docs, "__row")
    rows = keyed.select(F.col(id_col).cast("long").alias("id"), F.col("__row").alias("row"), F.col(text).alias("text"))
    found = _labelled(rows, words, percent)
    order = F.struct(F.col("id").isNull(), "id", "row")
    first = found.filter("component is not null").groupBy("component").agg(F.min(order)["row"].alias("__row"))
    stay = first.select("__row").unionByName(found.filter("component is null").select(F.col("row").alias("__row")))
    return keyed.join(stay, "__row", "left_semi").select(docs.columns)
