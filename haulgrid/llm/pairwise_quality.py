"""Quality classifier by pairwise preferences (Bradley-Terry).

A text's strength is a linear function of bounded features. From pairs of a good and a bad text the weights are
learned by logistic loss on the difference of features, from a bounded sample. The share of bad texts among all labelled
ones that are not held out fixes the quantile of their strengths below which texts are rejected; a logistic curve through
that point gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import quantile
from .tables import chosen_by_hash, drop_table, map_arrow, remainder, write_table
from .word_arrays import Words, chunks, window_hashes

#: Labelled rows of either class and preference pairs that are learned from, at most.
ROWS_PER_CLASS = 10_000
PAIRS = 200_000
#: Score at the strength that separates kept from rejected texts.
CUT = 0.3
FOLDS = 5

_BYTES = np.arange(256)
_SYMBOL = np.isin(_BYTES, [ord(c) for c in "#*$%&|<>"])
_UPPER = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_LETTER = _UPPER | ((_BYTES >= ord("a")) & (_BYTES <= ord("z"))) | (_BYTES >= 128)
_DIGIT = (_BYTES >= ord("0")) & (_BYTES <= ord("9"))
_KINDS = [_SYMBOL, _UPPER, _LETTER, _DIGIT, _BYTES == ord("!"), _BYTES == ord("|"), _BYTES < 128]
FEATURES = 14


def features(texts: pa.Array) -> np.ndarray:
    """FEATURES bounded numbers for each text; NULL and empty texts get zeros but for the last, which marks them."""
    out = np.zeros((len(texts), FEATURES))
    for row, data, offsets in chunks(texts):
        words = Words(data, offsets)
        hashes = words.hashes(lower=False)
        sizes = (words.ends - words.starts).astype(float)
        ends = offsets[1:]
        tallies = []
        for kind in _KINDS:
            sums = np.concatenate([[0], np.cumsum(kind[data])])
            tallies.append(sums[ends] - sums[offsets[:-1]])
        symbol, upper, letter, digit, shout, bar, ascii_ = (t.astype(float) for t in tallies)
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            n, f = b - a, out[row + i]
            if n == 0:
                f[-1] = 1
                continue
            own = hashes[a:b]
            _, held = np.unique(own, return_counts=True)
            three = window_hashes(own, 3)
            f[0] = np.log1p(n) / 12
            f[1] = symbol[i] / (symbol[i] + n)
            f[2] = upper[i] / max(letter[i], 1)
            f[3] = shout[i] / (shout[i] + n)
            f[4] = bar[i] / (bar[i] + n)
            f[5] = digit[i] / max(ends[i] - offsets[i], 1)
            f[6] = (own[1:] == own[:-1]).mean() if n > 1 else 0
            f[7] = 1 - len(held) / n
            f[8] = 1 - len(np.unique(three)) / len(three) if len(three) else 0
            f[9] = held.max() / n if n > 9 else 0
            f[10] = min(sizes[a:b].mean() / 20, 1)
            f[11] = min(sizes[a:b].std() / 20, 1)
            f[12] = 1 / n
    return out


@dataclass
class QualityModel:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float
    prior: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), self.prior)
        z = np.clip(self.strength(x) - self.cut + np.log(CUT / (1 - CUT)), -500, 500)
        return 1 / (1 + np.exp(-z))


def learn(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3) -> QualityModel:
    """Bradley-Terry weights by Newton's method. With one class only, every score is the share of good rows."""
    prior = float(good.mean()) if len(good) else 0.5
    blank = QualityModel(np.zeros(FEATURES), np.zeros(FEATURES), np.ones(FEATURES), 0.0, prior)
    if not len(good) or not 0 < prior < 1:
        return blank
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    random = np.random.default_rng(7)
    n = min(pairs, good.sum() * (~good).sum())
    differences = z[random.choice(np.flatnonzero(good), n)] - z[random.choice(np.flatnonzero(~good), n)]
    weights = np.zeros(FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(differences @ weights, -500, 500)))
        gradient = differences.T @ p / n - ridge * weights
        hessian = (differences * (p * (1 - p))[:, None]).T @ differences / n + ridge * np.eye(FEATURES)
        step = np.linalg.solve(hessian, gradient)
        weights = weights + step / max(1, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    strength = np.sort(z @ weights)
    bad = int((~good).sum())
    cut = (strength[bad - 1] + strength[min(bad, len(strength) - 1)]) / 2
    return QualityModel(weights, mean, scale, float(cut), prior)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("good"), pa.array(list(x), pa.list_(pa.float64()))], ["good", "x"]
        )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
    rows_per_class: int = ROWS_PER_CLASS, folds: int = FOLDS,
) -> QualityModel:
    """Learn from labelled rows whose id's crc32 mod ``folds`` is not 0, about ``rows_per_class`` of each label, by hash.

    The sample gives the weights only; cut and prior are those of all such rows. Rows with a NULL id or label teach nothing; of an id with several labels each counts. No labelled row: a model that
    gives 0.5 to all.
    """
    known = labels.filter(F.col(label).isin(0, 1) & (remainder(F.col(id_col), folds) != 0)).select(
        F.col(id_col).alias("__id"), (F.col(label) == 1).alias("good")
    ).distinct()
    sizes = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    key = F.xxhash64("__id")
    taken = known.filter(
        F.when(F.col("good"), chosen_by_hash(key, rows_per_class, sizes.get(True, 0)))
        .otherwise(chosen_by_hash(key, rows_per_class, sizes.get(False, 0)))
    )
    # about 2 * rows_per_class ids at most: bounded, whatever the tables hold
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("text")).join(F.broadcast(taken), "__id")
    found = map_arrow(rows.select("good", "text"), _features, "good boolean, x array<double>").toPandas()
    order = sorted(range(len(found)), key=lambda i: (found.good[i], tuple(found.x[i])))
    x = np.array([found.x[i] for i in order]).reshape(-1, FEATURES)
    model = learn(x, found.good.to_numpy(bool)[order])
    if not 0 < model.prior < 1 or max(sizes.values(), default=0) <= rows_per_class:
        return model
    return _at_true_share(docs.filter(remainder(F.col(id_col), folds) != 0), known, model, id_col, text)


def _at_true_share(docs: DataFrame, known: DataFrame, model: QualityModel, id_col: str, text: str) -> QualityModel:
    """``model`` with the cut and prior of all ``docs`` in ``known`` (__id, good): only ids and strengths are joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.strength(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(z)], ["__id", "z"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("text"))
    strengths = map_arrow(rows, run, f"__id {rows.schema['__id'].dataType.simpleString()}, z double")
    held = write_table(strengths.join(known, "__id").select("good", "z"), "strengths")
    n, bad = held.agg(F.count("z"), F.count_if(~F.col("good"))).first()
    cut = quantile(held, "z", (bad - 0.5) / (n - 1)).first()[0]  # halfway between the last rejected and the first kept
    drop_table(held)
    return replace(model, cut=cut, prior=1 - bad / n)


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all if None) with score and predicted (1 if score >= CUT); every row is scored whole."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(features(batch.column("__text")))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                [*keep, "score", "predicted"],
            )

    rows = docs.select(*keep, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return map_arrow(rows, run, f"{kinds}, score double, predicted int")


def accepted(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least CUT, with the columns of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(features(batch.column(text))) >= CUT))

    return map_arrow(docs, run, docs.schema)
