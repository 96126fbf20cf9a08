"""Quality rule on repetition inside a text, by suffix arrays over its words.

All texts of a chunk share one suffix array, built by prefix doubling; the rank of a suffix starts with its text's number, so
texts never mix. Each round doubles the compared length and sorts only suffixes that are still tied. The kept ranks of all
rounds give the longest common prefix of neighbours: the intervals of these prefixes are the maximal repeats. A word
position's longest repeat is the larger one of its two neighbours' prefixes, so the union of all repeats of at least
``MIN_WORDS`` words is the union of these stretches.

The base rule counts words in runs of five. The verdict goes by characters: repeats of any number of words count if they have
``MIN_CHARS`` characters, separators between their words included. So it also sees stuttering ("the the the the an an an an")
and repeated long words, of which no run of five words occurs twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow
from .word_arrays import Words, chunks

MIN_WORDS = 5
LEAST_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: The method's own limits: characters in repeats, of those in words, and the longest repeat in words and in percent of the
#: text's characters from its first word to its last. Of the texts of the sample tables that pass the base rule, 99.9 % have at
#: most 20 % of their characters in repeats, and none that is not stuttering over 25 %.
MIN_CHARS = 16
MAX_COVERED_PERCENT = 30
MAX_LONGEST = 100
MAX_LONGEST_PERCENT = 25
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat", "longest_chars", "text_chars",
)
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return new


def longest_repeats(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word the length in words of the longest run from it that occurs elsewhere in its text.

    ``first``: the number of words before each text, and after the last.
    """
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    order = np.lexsort((hashes, text))
    new = _starts(text[order], hashes[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    levels, tied, length = [rank], _tied(order, new), 1
    while len(tied):
        after = tied + length
        second = np.where(after < end[tied], rank[np.minimum(after, n - 1)], 0)
        inner = np.lexsort((second, rank[tied]))
        tied, second = tied[inner], second[inner]
        old = rank[tied]
        group, new = np.flatnonzero(_starts(old)), _starts(old, second)
        place = np.arange(len(tied))
        within = place - group[np.cumsum(_starts(old)) - 1]
        rank = rank.copy()
        rank[tied] = (old + within)[np.flatnonzero(new)[np.cumsum(new) - 1]]
        levels.append(rank)
        tied, length = _tied(tied, new), 2 * length
    sorted_ = np.empty(n, np.int64)
    sorted_[rank - 1] = np.arange(n)
    a, b = sorted_[:-1], sorted_[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[live], b[live]
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common[live], b + common[live]
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common[live[same]] += 1 << k
    out = np.zeros(n, np.int64)
    out[sorted_[:-1]] = common
    out[sorted_[1:]] = np.maximum(out[sorted_[1:]], common)
    return out


def _tied(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The members of groups of two and more."""
    alone = new & np.append(new[1:], True)
    return order[~alone]


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _dup_lines(text: bytes) -> int:
    seen, repeats = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    return repeats


def _union(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in one of the stretches."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def measure(texts: pa.Array, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> dict[str, np.ndarray | list]:
    """Counts, covered characters, longest repeats and the spans of repeats of ``min_words`` (word numbers: start, end, start, …)."""
    out = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
    spans: list[list[int]] = []
    for row, data, offsets in chunks(texts):
        words = Words(data, offsets)
        first, rows = words.first, slice(row, row + len(offsets) - 1)
        point = (data & 0xC0) != 0x80
        char = ~words.separates & point
        chars_before, points_before = (np.concatenate([[0], np.cumsum(x)]) for x in (char, point))
        repeat = longest_repeats(words.hashes(lower=False), first)
        n = len(repeat)
        long = np.flatnonzero(repeat >= min_words)
        covered = _union(long, repeat[long], n)
        again = np.flatnonzero(repeat)
        chars = np.zeros(n, np.int64)
        chars[again] = points_before[words.ends[again + repeat[again] - 1]] - points_before[words.starts[again]]
        wide = np.flatnonzero(chars >= min_chars)
        in_repeats = covered | _union(wide, repeat[wide], n)
        out["n_words"][rows] = np.diff(first)
        out["word_chars"][rows] = _sums(char, offsets)
        out["n_symbols"][rows] = _sums(_SYMBOL[data], offsets)
        out["n_dup_lines"][rows] = [_dup_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        out["n_repeat_words"][rows] = _sums(covered, first)
        out["covered_chars"][rows] = _sums(
            np.where(in_repeats, chars_before[words.ends] - chars_before[words.starts], 0), first
        )
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            if b > a:
                out["longest_repeat"][row + i], out["longest_chars"][row + i] = repeat[a:b].max(), chars[a:b].max()
                out["text_chars"][row + i] = points_before[words.ends[b - 1]] - points_before[words.starts[a]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]])))
            spans.append(edge)
    return out | {"repeat_spans": spans}


def _measure(keep: list[str], min_words: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column("__text"), min_words, min_chars)
            spans = pa.array(found.pop("repeat_spans"), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *[pa.array(v) for v in found.values()], spans],
                [*keep, *found, "repeat_spans"],
            )

    return run


def judge_repetition(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, min_words: int = MIN_WORDS,
    max_covered_percent: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST,
    max_longest_percent: int = MAX_LONGEST_PERCENT, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``keep`` columns of ``docs`` (all if None) with counts, repeat_spans, base_failed and kept.

    ``covered_chars`` are the characters of words in repeats of at least ``min_words`` words or ``min_chars`` characters.
    NULL and empty texts have no word: all counts are 0 and they fail the base rule. Repeated rows get the same row each.
    Columns of ``docs`` with the names of results give way to them. No rows: no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*COUNTS, "repeat_spans", "base_failed", "kept")]
    rows = docs.select(*keep, F.col(text).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields]
    kinds += [f"{c} long" for c in COUNTS] + ["repeat_spans array<long>"]
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    fine = (F.col("covered_chars") * 100 <= F.col("word_chars") * max_covered_percent) & (
        F.col("longest_repeat") <= max_longest
    ) & (F.col("longest_chars") * 100 <= F.col("text_chars") * max_longest_percent)
    return (
        map_arrow(rows, _measure(keep, min_words, min_chars), ", ".join(kinds))
        .withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
    )
