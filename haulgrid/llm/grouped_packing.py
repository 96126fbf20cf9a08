"""Best-fit packing of token sequences by linear grouping.

Texts become pieces of at most ``capacity`` tokens. Only the number of pieces of each length, at most ``capacity`` numbers
whatever the size of the table, decides how pieces are packed:

1. Large lengths are put into groups of equal cardinality and rounded up to the largest of their group.
2. For these few sizes the best configurations are found by column generation: a simplex over configurations, priced by a
   knapsack; whole multiples of the solution are used.
3. Actual lengths take the places of the rounded ones, largest first, so every place has room. What rounding up wastes is
   bounded: a configuration is filled only as long as its actual lengths leave at most so many tokens free.
4. What is left over and all small lengths go, longest first, to the fullest sequences with room (best fit). Of the plans for
   the bounds in ``WASTES`` the one with fewest sequences is taken.

The result is a table of runs: sequences filled alike, with a range of ranks for each length. A piece finds its sequence by
its rank among the pieces of its length; ranks come from counts per task, so no length is gathered in one place.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import map_arrow, write_table

CAPACITY = 2048
#: Lengths above capacity / SMALL_PART are large; they are rounded to so many sizes.
SMALL_PART = 8
GROUPS = 40
#: Tokens that a filled configuration may leave free, as parts of the capacity.
WASTES = (1.0, 1 / 32, 1 / 512, 0.0)
#: A cache of words is emptied when it holds so many.
CACHED_WORDS = 400_000

# ---------------------------------------------------------------------------------------------------- tokens

#: Texts of these characters only are split here; any other goes to the tokenizer as a whole.
_PLAIN = re.compile("[^\t-\r\x20-\x7e\xa0-įı-ſ‐-‧‰-⁞₠-₿]")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ſ0-9²³¹¼-¾]+")


class WordTokens:
    """Token ids of a byte-pair vocabulary with word ends, word by word, as little-endian 32-bit bytes.

    Valid for a vocabulary whose pre-tokenizer is ``_SPLIT`` after lower-casing (word_bpe_49k.json). A text with a
    character outside ``_PLAIN``, not in composed form, or with a special token's string is given to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = sorted(pre_tokenizers.ByteLevel.alphabet())
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shifted = [b for b in range(256) if b not in kept]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(shifted)}
        if sorted(self.letters.values()) != letters:
            raise ValueError("the tokenizer's byte alphabet has changed")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = _SPLIT.findall(text.lower())
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known.get(w) or self._word(w) for w in words])


_PIECE = ("id", "piece", "start", "length", "ids_crc32")


def _pieces(path: str, capacity: int):
    """Pieces with their number among those of their length in this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seen = WordTokens(path), TaskContext.get().partitionId(), Counter()
        end, width = (0).to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = tokens.encode(text.as_py() or "") + end
                for at in range(0, len(ids), width):
                    cut = ids[at : at + width]
                    row.append(i)
                    piece.append(at // width)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    nth.append(seen[len(cut)])
                    seen[len(cut)] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 *[pa.array(x, pa.int64()) for x in (start, length, crc, nth)], pa.array([part] * len(row), pa.int32())],
                [*_PIECE, "nth", "part"],
            )

    return run


# ------------------------------------------------------------------------------------------------------ plan

def _knapsack(values: np.ndarray, sizes: list[int], limits: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration, with at most ``limits`` of each size."""
    best = np.zeros(capacity + 1)
    taken = []
    for value, size, limit in zip(values, sizes, limits):
        number = np.zeros(capacity + 1, np.int32)
        new = best.copy()
        for n in range(1, min(capacity // size, limit) + 1):
            better = best[: capacity + 1 - n * size] + n * value
            gain = better > new[n * size :] + 1e-12
            new[n * size :][gain] = better[gain]
            number[n * size :][gain] = n
        best = new
        taken.append(number)
    room, out = int(np.argmax(best)), np.zeros(len(sizes), np.int64)
    total = best[room]
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = taken[i][room]
        room -= out[i] * sizes[i]
    return total, out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[int, np.ndarray]]:
    """(times, how many of each size) with times rounded down; what they don't cover is left to the caller."""
    k = len(sizes)
    if k == 0:
        return []
    basis = np.diag([max(1, capacity // s) for s in sizes]).astype(float)
    need = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amounts = inverse @ need
        value, column = _knapsack(inverse.sum(axis=0), sizes, demand, capacity)
        if value <= 1 + 1e-9:
            break
        direction = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, np.maximum(amounts, 0) / direction, np.inf)
        leaving = int(np.argmin(ratio))
        if not np.isfinite(ratio[leaving]):
            break
        basis[:, leaving] = column
    amounts = np.floor(np.linalg.inv(basis) @ need + 1e-6).astype(np.int64)
    return [(int(t), basis[:, i].round().astype(np.int64)) for i, t in enumerate(amounts) if t > 0]


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) from long to short, in groups of equal cardinality; a length may be divided."""
    total = sum(counts.values())
    out, room = [], 0
    for i, length in enumerate(sorted(counts, reverse=True)):
        left = counts[length]
        while left:
            if room == 0:
                room = (total * (len(out) + 1)) // groups - (total * len(out)) // groups
                out.append([])
                if room == 0:
                    continue
            n = min(left, room)
            out[-1].append((length, n))
            left -= n
            room -= n
    return [g for g in out if g]


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """(number of sequences, the lengths in each) for so many pieces of each length; every piece is placed."""
    left = {length: n for length, n in counts.items() if n > 0}
    whole = [(left.pop(capacity), [capacity])] if capacity in left else []
    large = {length: n for length, n in left.items() if length * SMALL_PART > capacity}
    merged: dict[int, list[tuple[int, int]]] = {}
    for g in linear_groups(large, groups):  # groups of one size, as of a length that fills several of them, are one
        merged.setdefault(g[0][0], []).extend(g)
    sizes = sorted(merged, reverse=True)
    members = [merged[s] for s in sizes]
    found = configurations(sizes, [sum(n for _, n in q) for q in members], capacity)
    plans = []
    for waste in WASTES:
        runs, rest = _substitute(found, members, left, capacity, int(waste * capacity))
        plans.append(_best_fit(whole + runs, rest, capacity))
    return min(plans, key=lambda runs: sum(n for n, _ in runs))


def _substitute(
    found: list[tuple[int, np.ndarray]], members: list[list[tuple[int, int]]], left: dict[int, int], capacity: int, waste: int
) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """Runs of actual lengths in the places of configurations with at most ``waste`` free, and what is left of each length."""
    queues, left, runs = [list(q) for q in members], dict(left), []
    for times, column in found:
        places = [g for g, n in enumerate(column) for _ in range(n)]
        while times and all(sum(n for _, n in queues[g]) for g in set(places)):
            # as many sequences as the foremost actual lengths of the groups allow to be filled alike
            taken, lengths = {}, []
            for g in places:
                i, used = taken.setdefault(g, [0, {}]), None
                used = i[1]
                j = next((j for j, (_, n) in enumerate(queues[g]) if n > used.get(j, 0)), None)
                if j is None:
                    lengths = []
                    break
                used[j] = used.get(j, 0) + 1
                lengths.append(queues[g][j][0])
            if not lengths or capacity - sum(lengths) > waste:
                break
            n = min([times, *[queues[g][j][1] // m for g, (_, used) in taken.items() for j, m in used.items()]])
            for g, (_, used) in taken.items():
                for j, m in used.items():
                    queues[g][j] = (queues[g][j][0], queues[g][j][1] - n * m)
                queues[g] = [x for x in queues[g] if x[1]]
            for length in lengths:
                left[length] -= n
            times -= n
            runs.append((n, lengths))
    return runs, left


def _best_fit(runs, left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Place what is left, longest first, into the fullest sequences with room, and else into new ones."""
    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    for n, lengths in runs:
        by_room.setdefault(capacity - sum(lengths), []).append((n, lengths))
    rooms = sorted(by_room)

    def put(n, lengths):
        room = capacity - sum(lengths)
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((n, lengths))

    for length in sorted(left, reverse=True):
        need = left[length]
        while need:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, need)
                n = need // each
                put(n, [length] * each)
                need -= n * each
                continue
            room = rooms[at]
            n, lengths = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            each = min(room // length, need)
            used = min(n, need // each)
            if used < n:
                put(n - used, lengths)
            put(used, lengths + [length] * each)
            need -= used * each
    return [run for same in by_room.values() for run in same]


def places(runs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number of ranks, first sequence, offset): where the pieces of each length go."""
    out, ranks, sequence = [], {}, 0
    for n, lengths in runs:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            out.append((length, first, n, sequence, offset))
            ranks[length] = first + n
            offset += length
        sequence += n
    return out


# ------------------------------------------------------------------------------------------------------- job

def _place(table: list[tuple[int, int, int, int, int]]):
    known: dict[int, list] = {}
    for length, first, _, sequence, offset in table:
        known.setdefault(length, []).append((first, sequence, offset))
    known = {k: np.array(sorted(v), np.int64) for k, v in known.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                runs = known[int(length[rows[0]])]
                at = np.searchsorted(runs[:, 0], rank[rows], side="right") - 1
                sequence[rows] = runs[at, 1] + rank[rows] - runs[at, 0]
                offset[rows] = runs[at, 2]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in _PIECE], pa.array(sequence), pa.array(offset)],
                [*_PIECE, "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Pieces of all texts and where they lie in sequences of at most ``capacity`` tokens.

    Columns: the id, piece, start, length, ids_crc32, sequence_id, offset. A text is its token ids and a closing 0; only
    texts longer than ``capacity`` are cut. NULL and empty texts are the closing 0 alone, so every row has a piece.
    Repeated rows are packed each for itself, rows with a NULL id too. Other columns are not looked at. No rows: no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    columns = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    pieces = write_table(
        map_arrow(rows, _pieces(tokenizer, capacity), columns + ", nth long, part int"), "pieces"
    )
    tally = write_table(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "tally")
    counts = {r[0]: r[1] for r in tally.groupBy("length").agg(F.sum("n")).collect()}
    table = places(plan_runs(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tally.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select(*_PIECE, (F.col("base") + F.col("nth")).alias("rank"))
    return map_arrow(ranked, _place(table), columns + ", sequence_id long, offset long").withColumnRenamed("id", id_col)
