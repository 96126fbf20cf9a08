"""Near duplicates by SimHash fingerprints, joined on indices of Golay codewords.

Fingerprint. A text's runs of four words are hashed (XXH64, seed 42); a bit of the fingerprint is 1 if it is set in
over half of the hashes, repeats included. Two fingerprints link when at most four of their 64 bits differ.

Keys. The fingerprint is cut into segments of 22, 21 and 21 bits, filled up with zeros to the 23 bits of the perfect binary Golay
code, in which every word lies within three bits of exactly one of 4,096 codewords. ``own`` is the codeword of a segment,
``near`` those of the segment and of all segments one bit away: one or six indices of 12 bits. Segments one bit apart have
each other's own among their near ones; segments two bits apart share a near one, that of the segment between them.

Pigeonhole. Four errors in three segments leave either two segments with at most one error each, or one with none and two with
two each. The first case meets in (near of i, own of j) on one side and (own of i, near of j) on the other, for one of the three
pairs of segments; the second in (segment i itself, near of i + 1) on both sides. That is 33 keys of 24 or more bits for a
side of a fingerprint, and every linked pair shares at least one.

Joining. Only distinct fingerprints are joined. In each group of a key all are first compared with the group's leader, the
fingerprint with most documents, and the links give components. Then the other members of a group meet, if they are in *different*
components and their distances to the leader allow a link (the triangle inequality), and a link is kept once for two components, so a group of near copies gives no all-pairs output and no link
is lost. Distinct fingerprints that share a key by chance are bounded by nothing but the key's 24 bits: n of them make about
n * n * 5e-6 comparisons of two numbers, which never leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import attach_by_key
from .components import connected_components
from .grouped_pairs import meet
from .tables import drop_table, map_arrow, write_table

WORDS = 4
SEED = 42
#: Bits that two linked fingerprints may differ in; the keys are made for this number.
BITS = 4
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Shingles that are hashed before their bits are counted.
STEP = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
A, B = 1, 2


def _rests() -> np.ndarray:
    """The rest of x^i after division by the generator, for the 23 places of a word."""
    out, x = [], 1
    for _ in range(23):
        out.append(x)
        x <<= 1
        if x >> 11:
            x ^= GENERATOR
    return np.array(out, np.int64)


def _table(rests: np.ndarray) -> np.ndarray:
    """The rest of every number made of the places ``rests`` belong to."""
    out = np.zeros(1, np.int64)
    for r in rests:
        out = np.concatenate([out, out ^ r])
    return out


def _errors(rests: np.ndarray) -> np.ndarray:
    """By rest: the only pattern of at most three bits that leaves it."""
    out = np.zeros(1 << 11, np.int64)
    for n in range(4):
        for places in combinations(range(23), n):
            out[np.bitwise_xor.reduce(rests[list(places)]) if n else 0] = sum(1 << p for p in places)
    return out


_RESTS = _rests()
_LOW, _HIGH, _ERRORS = _table(_RESTS[:12]), _table(_RESTS[12:]), _errors(_RESTS)


def decode(x: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each word of 23 bits."""
    rest = _LOW[x & 0xFFF] ^ _HIGH[x >> 12]
    return (x ^ _ERRORS[rest]) >> 11


def near_codewords(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The codewords of each word and of all words one of its lowest ``bits`` bits away, and which are the first of their kind.

    Column 0 holds the word's own codeword; a repeated index is marked False.
    """
    around = np.concatenate([[0], 1 << np.arange(bits)])
    found = decode(x[:, None] ^ around)
    others = np.sort(found[:, 1:], axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 2:] = others[:, 1:] != others[:, :-1]
    found[:, 1:] = others
    fresh[:, 1:] &= others != found[:, :1]
    return found, fresh


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends[min(WORDS, len(words)) - 1 :].tolist()
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(ends), STEP):
        own = [hashed(line[a:b], SEED) for a, b in zip(starts[i : i + STEP], ends[i : i + STEP])]
        bits = np.unpackbits(np.array(own, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = (counts * 2 > len(ends)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, sides) of every key of each 64-bit fingerprint; sides is A, B or both of them."""
    x = fingerprints.astype(np.uint64)
    parts = [(x >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [near_codewords(p, n) for p, (_, n) in zip(parts, SEGMENTS)]
    rows, keys, sides = [], [], []

    def add(kind: int, key: np.ndarray, fresh: np.ndarray, side: int):
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append(key[r, c] | kind << 40)
        sides.append(np.full(len(r), side, np.int8))

    for i in range(3):
        j = (i + 1) % 3
        (xi, fi), (xj, fj) = near[i], near[j]
        both = np.concatenate([fi[:, :1], np.zeros_like(fi[:, 1:])], axis=1)
        add(i, xi << 12 | xj[:, :1], both, A | B)
        add(i, xi << 12 | xj[:, :1], fi & ~both, A)
        add(i, xi[:, :1] << 12 | xj, fj & (np.arange(fj.shape[1]) > 0), B)
        add(3 + i, parts[i][:, None] << 12 | xj, fj, A | B)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, n = batch.column("fp").to_numpy(), batch.column("n").to_numpy()
        rows, keys, sides = golay_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(sides), pa.array(fp[rows]), pa.array(n[rows])], ["key", "sides", "fp", "n"]
        )


def _close(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= BITS


def _roots(distinct: DataFrame) -> DataFrame:
    """(fp, root) of the fingerprints that are linked with another one."""
    keys = map_arrow(distinct.select("fp", "n"), _keys, "key long, sides byte, fp long, n long")
    group = Window.partitionBy("key")
    members = write_table(
        keys.select(
            "key", "sides", "fp", F.count(F.lit(1)).over(group).alias("held"),
            F.max(F.struct("n", "fp")).over(group)["fp"].alias("leader"),
        ).filter("held > 1"), "members",
    )
    stars = members.filter(_close("fp", "leader") & (F.col("fp") != F.col("leader")))
    first = connected_components(stars.select(F.col("fp").alias("u"), F.col("leader").alias("v")))
    # the leader has met them all, so only groups of three and more have pairs left, none of them with the leader
    others = members.filter((F.col("held") > 2) & (F.col("fp") != F.col("leader"))).withColumn(
        "away", F.bit_count(F.col("fp").bitwiseXOR(F.col("leader")))
    ).drop("leader", "held")
    named = others.join(first, F.col("fp") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    # distances to the leader differ by at most BITS in a linked pair: who is linked with the leader meets only those up to
    # 2 * BITS away, who is further away only those not linked with it
    within, beyond = F.col("away") <= 2 * BITS, F.col("away") > BITS
    may_meet = {"all": F.lit(True), "within": within, "beyond": beyond}
    ends = [
        end(F.when(rows, F.col("component"))).over(group).alias(f"{name}_{kind}")
        for kind, rows in may_meet.items() for name, end in (("least", F.min), ("most", F.max))
    ]
    needed = F.when(~beyond, F.col("least_within") < F.col("most_within")).when(
        ~within, F.col("least_beyond") < F.col("most_beyond")
    ).otherwise(F.col("least_all") < F.col("most_all"))
    mixed = write_table(
        named.select("key", "sides", "fp", "component", "away", *ends).filter(needed).select(
            "key", "sides", "fp", "component", F.count(F.lit(1)).over(group).alias("held"),
        ), "mixed",
    )
    drop_table(members)
    apart = (F.col("a_component") < F.col("b_component")) & _close("a_fp", "b_fp")
    links = meet(
        mixed.filter(F.col("sides").bitwiseAND(F.lit(A)) > 0), mixed.filter(F.col("sides").bitwiseAND(F.lit(B)) > 0),
        ["key"], apart, "fp",
    )
    second = connected_components(links.select(F.col("a_component").alias("u"), F.col("b_component").alias("v")))
    drop_table(mixed)
    second = second.select(F.col("node").alias("up"), F.col("component").alias("top"))
    # a component's own name is no node of the first table
    once = first.select(F.col("node").alias("fp"), F.col("component").alias("up"))
    named_up = once.join(second, "up", "left").select("fp", F.coalesce("top", "up").alias("root"))
    return named_up.unionByName(
        second.select(F.col("up").alias("fp"), F.col("top").alias("root"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the fingerprint (16 lower-case hex digits) and component_id.

    Words are runs of anything but space and tab to carriage return, A-Z in lower case; shingles are four words joined by single
    spaces. A text with fewer words is one shingle; NULL and texts without words have fingerprint zero, which links like any
    other. component_id is the smallest id reachable by links of at most four differing bits, the row's own
    included; rows with a NULL id take part and get it too, or NULL if all ids are. Repeated rows and ids each give a row. Very
    long texts are hashed in steps. Other columns are not looked at. No rows: no rows.
    """
    rows = write_table(
        map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), _fingerprints, "id long, fp long"),
        "fingerprints",
    )
    distinct = write_table(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "distinct")
    labels = write_table(
        distinct.join(_roots(distinct), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "labels"
    )
    stats = labels.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    named = attach_by_key(labels.select("fp", "n", "root"), stats, ["root"], "rows")
    out = attach_by_key(rows, named.select("fp", "n", "component_id"), ["fp"], "n")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")
