"""Spelling variants by PartEnum signatures of letter multisets.

A word is the set of its letters numbered by occurrence (a1, a2, b1, ...), a binary vector. One deleted or inserted code
point changes one place of it, a replaced one two at most, so near words lie within Hamming distance two. The places are dealt
into parts by a fixed hash and signatures cover all parts but some (partition and enumerate):

- words of one length: 7 parts, all but two of them, 21 signatures;
- words whose lengths differ by one, which differ in one place: 5 parts, all but one of them, 5 signatures for a word as the
  shorter one and 5 as the longer one.

The place vectors of two near words agree outside the parts left out of at least one signature, so an equi-join on length and
signature finds every near pair. Candidates pass a bound on their parity sketches of 64 bits (Hamming distance two) and
then an exact edit distance of one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import attach_by_key
from .grouped_pairs import meet
from .tables import drop_table, map_arrow, write_table
from .word_arrays import mix

#: Code points of a word, at least, and its occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as its variant.
TIMES = 10
#: One occurrence in so many, by hash, loses a code point.
SLIP = 31
#: Parts of the letter places and how many a signature leaves out: for equal lengths, and for lengths that differ by one.
SAME, STEP = (7, 2), (5, 1)
#: Different words a task counts before it passes them on.
HELD = 1 << 17
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Which side of a pair a signature row may be: either one, the shorter or the longer word.
EITHER, SHORTER, LONGER = 0, 1, 2


def slipped(run: str, prefix_crc: int) -> str:
    """The run as it is counted: where 31 divides the hash of ``<doc_id>:<run>``, one code point is gone."""
    h = zlib.crc32(run.encode(), prefix_crc)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int, held: int):
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                for found, n in Counter(runs.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER).decode())).items():
                    word = slipped(found, prefix)
                    if len(word) >= least:
                        counts[word] += n
                if len(counts) > held:
                    yield table(counts)
                    counts = Counter()
        yield table(counts)

    return run


def letter_places(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each place, where a word's places begin, its length) of the numbered letters of all words."""
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((letters, owner))
    letters = letters[order]
    fresh = np.ones(len(letters), bool)
    fresh[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    nth = np.arange(len(letters)) - first[np.cumsum(fresh) - 1]
    return mix((letters << 32 | nth).astype(np.uint64)), np.cumsum(lengths) - lengths, lengths


def _totals(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[starts + lengths] - sums[starts]


def part_sums(places, starts, lengths, parts: int) -> np.ndarray:
    """One hash per word and part: of the set of its places in that part."""
    own, value = places >> np.uint64(40), mix(places)
    none = np.uint64(0)
    return np.column_stack([
        mix(_totals(np.where(own % np.uint64(parts) == p, value, none), starts, lengths) + np.uint64(p + 1))
        for p in range(parts)
    ])


def parity_sketch(places, starts, lengths) -> np.ndarray:
    """The parity of the places that hash to each of 64 bits: words d places apart differ in at most d bits."""
    bits = np.uint64(1) << (places >> np.uint64(20) & np.uint64(63))
    sums = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bits)])
    return sums[starts + lengths] ^ sums[starts]


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word number, key, side) of all signatures, and the sketch of each word; words are not empty."""
    places, starts, lengths = letter_places(words)
    number = np.arange(len(words))
    rows, keys, sides = [], [], []
    for (parts, left_out), roles in ((SAME, ((EITHER, 0),)), (STEP, ((SHORTER, 0), (LONGER, 1)))):
        sums = part_sums(places, starts, lengths, parts)
        for choice, out in enumerate(combinations(range(parts), left_out)):
            kept = sums[:, [p for p in range(parts) if p not in out]].sum(axis=1, dtype=np.uint64)
            for side, less in roles:
                kind = np.uint64((choice + 1) << 8 | (side > 0))
                keys.append(mix(mix(kept + (lengths - less).astype(np.uint64)) + kind))
                rows.append(number)
                sides.append(np.full(len(words), side, np.int8))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(sides), parity_sketch(places, starts, lengths)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        word, n = batch.column("word"), batch.column("n")
        rows, keys, sides, sketch = signatures(word.to_pylist())
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(sides), word.take(at), n.take(at), pa.array(sketch.view(np.int64)[rows])],
            ["key", "side", "word", "n", "sketch"],
        )


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words with at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences."""
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    counted = map_arrow(texts, _counted(LEAST_LENGTH, HELD), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words (word, n; distinct) one code point apart, once, in either order."""
    signed = map_arrow(words.select("word", "n"), _signed, "key long, side byte, word string, n long, sketch long")
    group = Window.partitionBy("key")
    members = write_table(
        signed.select(
            "*", F.count(F.lit(1)).over(group).alias("held"), F.min("side").over(group).alias("x"), F.max("side").over(group).alias("y")
        ).filter("held > 1 and (x < y or x = 0)").drop("x", "y"), "members",
    )
    near = (
        (F.bit_count(F.col("a_sketch").bitwiseXOR(F.col("b_sketch"))) <= 2)
        & (F.levenshtein("a_word", "b_word", 1) == 1)
    )
    either, columns = members.filter(f"side = {EITHER}"), ["a_word", "a_n", "b_word", "b_n"]
    same = meet(either, either, ["key"], (F.col("a_word") < F.col("b_word")) & near, "word").select(columns)
    step = meet(
        members.filter(f"side = {SHORTER}"), members.filter(f"side = {LONGER}"), ["key"], near, "word"
    ).select(columns)
    out = write_table(
        same.unionByName(step).distinct().select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n"), "near"
    )
    drop_table(members)
    return out


def _roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) of every word with a form (word, up): the chain of forms is followed by doubling; written."""
    now = write_table(forms.select("word", "up"), "roots")
    for _ in range(rounds):
        # words that share a form are many, so its next step is attached hot forms apart
        counted = now.groupBy("up").agg(F.count(F.lit(1)).alias("rows"))
        ahead = now.select(F.col("word").alias("up"), F.col("up").alias("next"))
        steps = counted.join(ahead, "up")
        if steps.isEmpty():
            return now.select("word", F.col("up").alias("root"))
        moved = attach_by_key(now, steps, ["up"], "rows").select("word", F.coalesce("next", "up").alias("up"))
        before, now = now, write_table(moved, "roots")
        drop_table(before)
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of all texts, the form it is a variant of and where forms lead.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case, less the code point that the
    hash rule deletes, with at least 7 code points and 2 occurrences. Near words differ by one inserted, deleted or
    replaced code point. The form is the near word with most occurrences (ties: the smallest in code-point order), if it has at
    least 10 times as many; else NULL. NULL and empty texts have no words; a NULL id is hashed as an empty one.
    Repeated rows count each time. A run of any length is one word. Other columns are not looked at. No words: no rows.
    """
    words = write_table(count_words(docs, id_col, text), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best")).alias("best"),
    )
    named = write_table(
        judged.select("word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")), "forms"
    )
    roots = _roots(named.filter("form is not null").select("word", F.col("form").alias("up")))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
