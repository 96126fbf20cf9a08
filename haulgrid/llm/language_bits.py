"""Language identification by bit-sliced Bloom filters over character n-grams.

A slot of the table holds one bit per language. An n-gram's slots ANDed give, in one step, the mask of all languages whose
filter contains it. A text is decided by the popcounts of its n-grams' masks per language, each corrected for the share
of unknown n-grams that the language's filter takes in by mistake.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import map_arrow, remainder
from .word_arrays import mix

#: About so many documents of a language are learned from, and at most so many of its n-grams are kept.
ROWS_PER_LANGUAGE = 4000
GRAMS_PER_LANGUAGE = 50_000
FOLDS, HELD_OUT = 4, 2
SIZES = (1, 2, 3)
#: A language contains an n-gram if it is at least this share as frequent there as where it is most frequent.
SHARE = 0.25
PROBES = 3
_SHIFTS = [np.uint64(i * 0xD6E8FEB86659FD93 & (1 << 64) - 1) for i in range(PROBES)]
SLOTS_PER_GRAM = 12
UNDETERMINED = "und"

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """The lower-case code point of every letter, 0 for any other character."""
    if not _tables:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables.append(out)
    return _tables[0]


def grams(text: str) -> np.ndarray:
    """64-bit hashes of the n-grams of a text's letters; what is between words counts as one space. None: no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _letters()[points]
    if not low.any():
        return np.empty(0, np.uint64)
    gap = low == 0
    low = low[~(gap & np.concatenate([[True], gap[:-1]]))]
    low = np.concatenate([[0], low, [0]]).astype(np.uint64)
    out, sums = [], np.zeros(len(low), np.uint64)
    for n in range(1, max(SIZES) + 1):
        sums = sums[: len(low) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + low[n - 1 :] + np.uint64(n)
        if n in SIZES:
            out.append(sums if n > 1 else sums[low > 0])
    return mix(np.concatenate(out))


@dataclass
class LanguageModel:
    """The languages in order, the table (slots x 64-bit words of language bits), false-positive rates and shares."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    common: int

    def masks(self, found: np.ndarray) -> np.ndarray:
        """One row of language bits for each n-gram."""
        size = np.uint64(len(self.table) - 1)
        out = None
        for i in range(PROBES):
            rows = self.table[(mix(found + _SHIFTS[i]) & size).astype(np.int64)]
            out = rows if out is None else out & rows
        return out

    def decide(self, text: str | None) -> tuple[str, float]:
        found = grams(text or "")
        if len(found) == 0 or not self.languages:
            return UNDETERMINED, 0.0
        masks = self.masks(found)
        bits = np.array([
            np.count_nonzero(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(self.languages))
        ])
        real = np.clip((bits / len(found) - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = int(np.argmax(real)) if real.any() else self.common
        return self.languages[best], float(real[best])


def build(counts: dict[str, dict[int, int]], share: float = SHARE) -> LanguageModel:
    """A model from n-gram counts by language; languages in alphabetical order."""
    languages = sorted(counts)
    rates, sums = {}, {lang: max(sum(counts[lang].values()), 1) for lang in languages}
    for i, lang in enumerate(languages):
        for gram, n in counts[lang].items():
            rates.setdefault(gram, {})[i] = n / sums[lang]
    words = max(1, -(-len(languages) // 64))
    slots = 1 << max(10, (max(len(rates), 1) * SLOTS_PER_GRAM - 1).bit_length())
    table = np.zeros((slots, words), np.uint64)
    model = LanguageModel(languages, table, np.zeros(len(languages)), 0)
    members: list[list[int]] = [[] for _ in languages]
    for gram, by in rates.items():
        most = max(by.values())
        for i, rate in by.items():
            if rate >= share * most:
                members[i].append(gram)
    for i, own in enumerate(members):
        found = np.array(own, np.int64).view(np.uint64)
        for k in range(PROBES):
            at = (mix(found + _SHIFTS[k]) & np.uint64(slots - 1)).astype(np.int64)
            table[at, i // 64] |= np.uint64(1 << (i % 64))
    for i in range(len(languages)):
        filled = np.count_nonzero(table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / slots
        model.false_rate[i] = filled**PROBES
    model.common = int(np.argmax([sums[lang] for lang in languages])) if languages else 0
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, dict[int, int]] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            found, n = np.unique(grams(text or ""), return_counts=True)
            own = totals.setdefault(lang, {})
            for gram, k in zip(found.view(np.int64).tolist(), n.tolist()):
                own[gram] = own.get(gram, 0) + k
    for lang, own in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())],
            ["lang", "gram", "n"],
        )


def train(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE, grams_per_language: int = GRAMS_PER_LANGUAGE,
) -> LanguageModel:
    """Learn from rows with a language whose id's crc32 mod FOLDS is not HELD_OUT.

    Of each language about ``rows_per_language`` documents, chosen by the hash of their ids, and their
    ``grams_per_language`` most frequent n-grams: bounded by the number of languages. Rows with a NULL id, text or
    language teach nothing. No such row: a model without languages, which answers ``und``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("lang").isNotNull() & (remainder(F.col("id"), FOLDS) != HELD_OUT)
    )
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    taken = rows.join(F.broadcast(sizes), "lang").filter(
        "text is not null and pmod(xxhash64(id), 1000003) < "
        f"1000003D * {rows_per_language} / rows"
    )
    counted = map_arrow(taken.select("lang", "text"), _count, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = summed.withColumn("place", place).filter(F.col("place") <= grams_per_language).drop("place")
    counts: dict[str, dict[int, int]] = {}
    for r in kept.collect():
        counts.setdefault(r[0], {})[r[1]] = r[2]
    model = build(counts)
    trained = {r[0]: r[1] for r in sizes.collect()}
    model.common = max(range(len(model.languages)), key=lambda i: trained[model.languages[i]], default=0)
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all if None) with lang_pred and score, from the whole text of every row.

    NULL, empty and letterless texts are ``und`` with score 0. Texts none of whose n-grams is known get the language with
    most training rows and score 0. Ties go to the first language in alphabetical order. Repeated rows get equal results.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.decide(t.as_py()) for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([x for x, _ in found], pa.string()),
                 pa.array([s for _, s in found], pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    rows = docs.select(*keep, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return map_arrow(rows, run, (kinds + ", " if kinds else "") + "lang_pred string, score double")
