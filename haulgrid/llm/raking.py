"""Mixing sources to target weights by iterative proportional fitting (raking).

Tokens are summed in cells, one for each combination of the dimensions' values. A sweep scales the cells' weights to the
target shares of one dimension after the other. A weight never exceeds 1 / share, at which every document of its cell is
taken; what such a cell cannot take, the next sweeps deal to the other cells of its values, so all margins still reach their targets.
That needs a sampling share under which no value wants more tokens than it has: it is ``SHARE`` or, if some value is too
scarce for it, ``HEADROOM`` times the largest share that the scarcest value allows. Documents are then sampled with the
calibrated probability weight x share. All is DataFrame operations: sums are made per task before they are shuffled, cells
are joined to documents, and a document's draw is a hash of its id, so a task that runs again draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import WORD, drop_table, write_table

#: Share of all tokens that the sample should hold at most, and sweeps over the dimensions.
SHARE = 0.5
SWEEPS = 8
#: Part of the largest feasible share that is used where ``SHARE`` is more, so that cells have room to trade.
HEADROOM = 0.9
DIMENSIONS = ("source", "lang", "topic")
LONG, SHORT = 1000, 100


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: Column, n: Column) -> Column:
    """What a text is about stands in no table; its form does: table, long, short or prose."""
    return (
        F.when(text.contains(" | "), "table").when(n >= LONG, "long").when(n < SHORT, "short").otherwise("prose")
    )


def draw(id_col: Column) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    digits = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def root_targets(cells: DataFrame, dimension: str) -> DataFrame:
    """(dimension, target): shares in proportion to the square root of tokens, which lifts small values."""
    sums = cells.groupBy(dimension).agg(F.sqrt(F.sum("n_tokens").cast("double")).alias("root"))
    total = sums.agg(F.sum("root").alias("total"))
    return sums.join(F.broadcast(total), F.lit(True)).select(dimension, (F.col("root") / F.col("total")).alias("target"))


def stated_targets(cells: DataFrame, dimension: str, shares: dict) -> DataFrame:
    """(dimension, target) from stated shares by value (None: NULL), which need not sum to one.

    Values of the table that are not listed keep their own share of tokens; the listed ones that it has divide the rest.
    """
    if any(v < 0 for v in shares.values()) or not any(v > 0 for v in shares.values()):
        raise ValueError("shares are zero or more, and some are more")
    listed = cells.sparkSession.createDataFrame(
        [("\0" if k is None else str(k), float(v)) for k, v in shares.items()], f"{dimension} string, __stated double"
    )
    sums = cells.groupBy(dimension).agg(F.sum("n_tokens").cast("double").alias("__own")).join(listed, dimension, "left")
    free = F.col("__stated").isNull()
    total = sums.agg(
        F.sum("__own").alias("__all"), F.sum(F.when(free, F.col("__own")).otherwise(0.0)).alias("__kept"),
        F.sum("__stated").alias("__parts"),
    )
    kept = F.col("__own") / F.nullif("__all", F.lit(0.0))
    stated = F.col("__stated") / F.nullif("__parts", F.lit(0.0)) * (1 - F.col("__kept") / F.nullif("__all", F.lit(0.0)))
    return sums.join(F.broadcast(total), F.lit(True)).select(dimension, F.coalesce(stated, kept, F.lit(0.0)).alias("target"))


def feasible_share(cells: DataFrame, targets: dict[str, DataFrame], share: float = SHARE) -> float:
    """``share``, or ``HEADROOM`` times the largest sampling share at which no value needs more tokens than it has."""
    total = cells.agg(F.sum("n_tokens").cast("double")).first()[0]
    least = None
    for dimension, target in targets.items():
        own = cells.groupBy(dimension).agg(F.sum("n_tokens").cast("double").alias("__own")).join(target, dimension)
        # values without tokens cannot be raised by any weight
        wanted = own.filter("target > 0 and __own > 0").agg(F.min(F.col("__own") / F.lit(total) / F.col("target"))).first()[0]
        least = wanted if least is None or (wanted is not None and wanted < least) else least
    return share if least is None else min(share, HEADROOM * least)


def rake(cells: DataFrame, targets: dict[str, DataFrame], share: float, sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (dimensions, n_tokens) with weight, at most 1 / ``share``, after ``sweeps`` sweeps towards the targets.

    Cells without tokens keep what their neighbours' factors give them; values without tokens or without a target
    are not scaled. No cells: no rows.
    """
    total = F.broadcast(cells.agg(F.sum("n_tokens").cast("double").alias("__total")))
    now = write_table(cells.join(total, F.lit(True)).withColumn("weight", F.lit(1.0)), "cells")
    for _ in range(sweeps):
        raked = now
        for dimension, target in targets.items():
            mass = raked.groupBy(dimension).agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("__mass"))
            factor = mass.join(target, dimension).select(dimension, "__mass", "target")
            raised = F.col("weight") * F.coalesce(F.col("target") * F.col("__total") / F.nullif("__mass", F.lit(0.0)), F.lit(1.0))
            raked = raked.join(factor, dimension, "left").withColumn("weight", F.least(raised, F.lit(1 / share))).drop(
                "__mass", "target"
            )
        before, now = now, write_table(raked, "cells")
        drop_table(before)
    return now.drop("__total")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: float = SHARE, sweeps: int = SWEEPS,
    targets: dict[str, dict] | None = None,
) -> DataFrame:
    """``docs`` with __source, __lang, __topic, __tokens, __weight, __probability and __sampled.

    ``targets`` has shares of tokens by value for some or all of the dimensions source, lang and topic (``stated_targets``);
    the others, and all if it is None, go by ``root_targets`` of the table. ``share`` is what the sample holds at most, see
    ``feasible_share``. NULL in a dimension is a value of its own. NULL and empty texts have no tokens and are sampled like
    their cell; a very long text is one document of many tokens. Rows of one id are drawn alike. Columns of ``docs`` stay as
    they are; source and lang must be among them. No rows: no rows.
    """
    words = tokens(F.col(text))
    marked = docs.withColumn("__tokens", words)
    for name in DIMENSIONS:
        value = topic(F.col(text), F.col("__tokens")) if name == "topic" else F.col(name).cast("string")
        marked = marked.withColumn(f"__{name}", F.coalesce(value, F.lit("\0")))
    keys = [f"__{name}" for name in DIMENSIONS]
    cells = write_table(marked.groupBy(*keys).agg(F.sum("__tokens").alias("n_tokens")), "tallies")
    stated = {f"__{name}": shares for name, shares in (targets or {}).items()}
    if not stated.keys() <= set(keys):
        raise ValueError(f"targets are for {', '.join(DIMENSIONS)}")
    wanted = {
        k: write_table(stated_targets(cells, k, stated[k]) if k in stated else root_targets(cells, k), "targets") for k in keys
    }
    share = feasible_share(cells, wanted, share)
    weights = rake(cells, wanted, share, sweeps)
    chance = F.least(F.col("__weight") * share, F.lit(1.0))
    return (
        marked.join(weights.select(*keys, F.col("weight").alias("__weight")), keys)
        .withColumn("__probability", chance).withColumn("__sampled", draw(F.col(id_col)) < F.col("__probability"))
    )


def sample(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: float = SHARE, targets: dict[str, dict] | None = None
) -> DataFrame:
    """The rows of ``docs`` that the calibrated probabilities draw, with the columns of ``docs``."""
    return mix_sources(docs, id_col, text, share, targets=targets).filter("__sampled").select(docs.columns)
