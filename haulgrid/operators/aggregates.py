"""Aggregations: totals, shares, modes, exact quantiles, histograms and densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import as_col, ratio, strict_sum
from ..session import materialize
from .ranking import group_value_ranks, value_counts
from .skew import beside


# a quantile is bracketed ever closer, by samples of so many values, until no more than so many lie between the ends
BRACKET_SAMPLE = 20_000
BRACKET_VALUES = 10_000


def sum_cols(cols: Sequence[str]) -> Column:
    """Sum over several columns and all rows; NULL if any cell is missing."""
    total = F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c)
    return strict_sum(total)


def count_by(df: DataFrame, *cols: str, measures: Sequence[Column] = ()) -> DataFrame:
    """Frequency per category with a label 'category (n)', and further measures in the same pass."""
    name = F.coalesce(F.col(cols[0]).cast("string"), F.lit("NA"))
    label = F.concat(name, F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), *measures).withColumn("label", label)


def share_of(df: DataFrame, predicate: Column, measure: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of the measure that meets a condition, per group, in one pass."""
    part = F.coalesce(F.sum(F.when(predicate, F.col(measure))), F.lit(0))
    return df.groupBy(*by).agg(ratio(part, F.sum(measure)).alias("share"))


def with_total_row(df: DataFrame, label_col: str, measures: Sequence[str], total_label: str | None = None) -> DataFrame:
    """A table unique by ``label_col`` plus one row holding the plain column sums."""
    rolled = df.rollup(label_col).agg(
        F.grouping(label_col).alias("__g"), *[F.sum(m).alias(m) for m in measures]
    )
    label = F.when(F.col("__g") == 1, F.lit(total_label)).otherwise(F.col(label_col))
    return rolled.select(label.alias(label_col), *measures)


def mode_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Most frequent value per group for each column; NULL is a candidate, ties go to the smallest value.

    Values are counted before they are compared, so no group is ever held in one place.
    """
    out = None
    for c in cols:
        counted = df.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__n"))
        # smallest value among the most frequent ones, NULL only if nothing else reaches the count
        best = counted.groupBy(*keys).agg(
            F.min_by(F.col(c), F.struct(-F.col("__n"), F.col(c).isNull(), F.col(c))).alias(c)
        )
        if out is None:
            out = best
        else:
            renamed = best.withColumnsRenamed({k: "__m_" + k for k in keys})
            cond = None
            for k in keys:
                term = F.col(k).eqNullSafe(F.col("__m_" + k))
                cond = term if cond is None else cond & term
            out = out.join(renamed, cond, "left").drop(*["__m_" + k for k in keys])
    return out


def _interpolated(below: str, n: str, total: int | None, col: str, p: float) -> Column:
    """Aggregate over value counts with the rows below each: interpolation between the order statistics around (n-1)p.

    ``total`` is the number of known rows; None takes it from the column of that name.
    """
    rows = F.col("total") if total is None else F.lit(total)
    h = (rows - 1) * F.lit(float(p))
    lo, hi = F.floor(h), F.ceil(h)

    def at(i: Column) -> Column:
        return F.max(F.when((F.col(below) <= i) & (i < F.col(below) + F.col(n)), F.col(col).cast("double")))

    return at(lo) + (at(hi) - at(lo)) * F.max(h - lo)


def _narrower(drawn: list[float], all_drawn: bool, lo: float, hi: float, place: float, after: float) -> tuple[float, float]:
    """Sampled values four standard errors before the share ``place`` and after the share ``after`` of an ordered sample."""
    n = len(drawn)

    def error(share):
        return 2 + (0 if all_drawn else 4 * math.sqrt(n * max(share * (1 - share), 0.0)))

    left, right = math.floor(place * n - error(place)), math.ceil(after * n + error(after))
    return (drawn[left] if left >= 0 else lo), (drawn[right] if right < n else hi)


def quantile(df: DataFrame, col: str, p: float, name: str = "q") -> DataFrame:
    """One-row table with the exact quantile (linear interpolation) of the known values.

    The two order statistics around (n - 1) p are bracketed by a sample of ``BRACKET_SAMPLE`` values; exact counts say how
    many lie below and inside the bracket, which is kept only where they prove it right, and the values inside are bracketed
    again until at most ``BRACKET_VALUES`` are left. Each round leaves one value in 50 or so. Tasks pass on a few counts each; no
    sketch is merged and no more than those two numbers of values ever meet in one place. The ends may have any number of copies.
    """
    v = F.col(col).cast("double")
    values = df.select(v.alias("v")).filter("v is not null")
    spark = df.sparkSession
    first = values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n, lo, hi = first["n"], first["lo"], first["hi"]
    if n == 0:
        return spark.createDataFrame([(None,)], f"`{name}` double")
    h = (n - 1) * float(p)
    i, j = math.floor(h), math.ceil(h)
    # values below lo, up to lo, and below hi; what is strictly between the ends is looked at in ``pool``, after ``base`` values
    below, up_to, under, pool, base, seed = 0, 0, n, values, 0, 0
    x = F.col("v")
    if n > BRACKET_VALUES:
        ends = values.agg(F.count_if(x <= lo).alias("up_to"), F.count_if(x < hi).alias("under")).first()
        up_to, under = ends["up_to"], ends["under"]
    while under - up_to > BRACKET_VALUES:
        inside = under - up_to
        between = pool.filter((x > lo) & (x < hi))
        drawn = sorted(r[0] for r in between.sample(min(1.0, BRACKET_SAMPLE / inside), seed=seed).collect())
        seed += 1
        place, after = (min(max((k - up_to) / inside, 0.0), 1.0) for k in (i, j))
        new_lo, new_hi = _narrower(drawn, inside <= BRACKET_SAMPLE, lo, hi, place, after)
        c = pool.agg(
            F.count_if(x < new_lo).alias("lt_lo"), F.count_if(x <= new_lo).alias("le_lo"),
            F.count_if(x < new_hi).alias("lt_hi"), F.count_if(x <= new_hi).alias("le_hi"),
        ).first()
        if new_lo > lo and base + c["lt_lo"] <= i:
            lo, below, up_to = new_lo, base + c["lt_lo"], base + c["le_lo"]
        if new_hi < hi and j < base + c["le_hi"]:
            hi, under = new_hi, base + c["lt_hi"]
        if pool is values and BRACKET_VALUES < under - up_to <= n // 4:
            pool, base = materialize(values.filter((x > lo) & (x < hi)), "bracket"), up_to
    near = values.filter(F.col("v").between(lo, hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + below
    return near.withColumn("below", before).agg(_interpolated("below", "n", n, "v", p).alias(name))


def quantiles_by(counted: DataFrame, by: Sequence[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group of value counts (``by``, ``col``, n), one column per entry of ``probs``.

    Values are ranked in range buckets, so no task sees a whole group.
    """
    return group_value_ranks(counted, by, col).groupBy(*by).agg(
        *[_interpolated("below", "n", None, col, p).alias(k) for k, p in probs.items()]
    )


def weighted_mean(df: DataFrame, by: Sequence[str], weight: str, skip: Sequence[str] = (),
                  strict: Sequence[str] = ()) -> DataFrame:
    """Weighted means whose weights stay shares of the whole group.

    ``skip`` columns leave missing values out of the numerator, ``strict`` columns turn NULL with one of them.
    """
    aggs = [strict_sum(weight).alias(weight)]
    aggs += [F.coalesce(F.sum(F.col(weight) * F.col(c)), F.lit(0.0)).alias("__n_" + c) for c in skip]
    aggs += [strict_sum(F.col(weight) * F.col(c)).alias("__n_" + c) for c in strict]
    out = df.groupBy(*by).agg(*aggs)
    cols = [*skip, *strict]
    return out.withColumns({c: ratio("__n_" + c, weight) for c in cols}).drop(*["__n_" + c for c in cols])


def all_pass(df: DataFrame, key: str, predicate: Column) -> DataFrame:
    """Keys all of whose rows meet the condition."""
    ok = F.coalesce(predicate, F.lit(False))
    return df.groupBy(key).agg(F.bool_and(ok).alias("__ok")).filter("__ok").select(key)


def designated(condition: Column, c: Column | str) -> Column:
    """Aggregate: the value of the one row that meets the condition."""
    return F.max(F.when(condition, as_col(c)))


def histogram(df: DataFrame, col: str, width: float | None = None, bins: int | None = None) -> DataFrame:
    """Counts in bins centred on multiples of the width; with ``bins`` the width follows from the range."""
    x = F.col(col)
    kept = df.filter(x.isNotNull())
    if width is not None:
        w = F.lit(float(width))
    else:
        # one bin for all if only one is wanted or all values are equal
        wide = (F.max(x) - F.min(x)) / max(bins - 1, 1)
        kept = beside(kept, df.agg(F.when(wide > 0, wide).alias("__w"), F.min(x).alias("__one"), F.max(x).alias("__top")))
        w = F.col("__w")
        if bins == 1:
            return kept.groupBy(((F.col("__one") + F.col("__top")) / 2).alias("bin_center")).agg(F.count(F.lit(1)).alias("n"))
        centre = F.when(w.isNull(), F.col("__one").cast("double")).otherwise(F.floor(x / w + 0.5) * w)
        return kept.groupBy(centre.alias("bin_center")).agg(F.count(F.lit(1)).alias("n"))
    binned = kept.select((F.floor(x / w + 0.5) * w).alias("bin_center"))
    return binned.groupBy("bin_center").agg(F.count(F.lit(1)).alias("n"))


def hist2d(df: DataFrame, x: str, y: str, wx: float, wy: float) -> DataFrame:
    """Counts in a rectangular grid of bins."""
    return (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.floor(F.col(x) / wx).alias("bin_x"), F.floor(F.col(y) / wy).alias("bin_y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: Cells that a bin of the density is cut into, to find the few that hold a quartile.
CELLS = 1024


def density(df: DataFrame, x: str, by: str, lo: float, hi: float, n: int = 512, bins: int = 1024) -> DataFrame:
    """Gaussian kernel density per category on ``n`` grid points over [lo, hi]; values outside are left out.

    Rows are read twice. First they are counted in ``CELLS`` cells per bin, with the sums that spread and nodes need: a value is
    shared between its two neighbouring bin nodes. The cells also tell in which of them the quartiles lie, and the second
    pass counts the values of those few cells. A category's ``bins + 1`` nodes are one array that its grid points are summed
    from, so no row per node and grid point is made. Bandwidth: 0.9 * min(sd, IQR / 1.34) * count^-0.2.
    """
    step, gap, middle = (hi - lo) / bins, (hi - lo) / (n - 1), (lo + hi) / 2
    v = F.col("__x")
    kept = df.filter(F.col(x).between(lo, hi)).select(F.col(by).alias("__by"), F.col(x).cast("double").alias("__x"))
    pos = (v - lo) / step
    left = F.least(F.floor(pos), F.lit(bins - 1))
    cell = left * CELLS + F.least(F.floor((pos - left) * CELLS), F.lit(CELLS - 1))
    placed = kept.withColumn("__cell", cell)
    # deviations from the middle of the range keep the digits that squares of large values would lose
    d = v - middle
    cells = materialize(
        placed.groupBy("__by", "__cell").agg(
            F.count(F.lit(1)).alias("n"), F.sum(pos - left).alias("right"), F.sum(d).alias("d"), F.sum(d * d).alias("dd"),
            F.max(F.abs(v)).alias("top"),
        ), "density-cells",
    )
    # at most bins * CELLS cells a category
    before = Window.partitionBy("__by").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.select(
        "__by", "__cell", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy("__by")).alias("total"),
    )
    wanted = F.lit(False)
    for p in (0.25, 0.75):
        h = (F.col("total") - 1) * p
        for i in (F.floor(h), F.ceil(h)):
            wanted = wanted | ((F.col("start") <= i) & (i < F.col("start") + F.col("n")))
    held = ranked.filter(wanted).select(
        F.col("__by").alias("__qb"), F.col("__cell").alias("__qc"), "start", "total"
    )
    counted = (
        placed.join(held, F.col("__by").eqNullSafe(F.col("__qb")) & (F.col("__cell") == F.col("__qc")))
        .groupBy("__by", "__cell", "start", "total", "__x").agg(F.count(F.lit(1)).alias("n"))
    )
    inside = Window.partitionBy("__by", "__cell").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    quart = counted.withColumn("below", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).groupBy("__by").agg(
        *[_interpolated("below", "n", None, "__x", p).alias(k) for k, p in (("__q1", 0.25), ("__q3", 0.75))]
    ).withColumnRenamed("__by", "__qb")
    rows, total = F.sum("n"), F.sum("d")
    variance = (F.sum("dd") - total * total / rows) / (rows - 1)
    spread = cells.groupBy("__by").agg(
        F.when(rows > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("__sd"), rows.alias("__n"), F.max("top").alias("__abs"),
    )
    iqr = (F.col("__q3") - F.col("__q1")) / 1.34
    low = F.when(F.least("__sd", iqr) > 0, F.least("__sd", iqr)).when(F.col("__sd") > 0, F.col("__sd"))
    low = low.when(F.col("__abs") > 0, F.col("__abs")).otherwise(F.lit(1.0))
    width = (
        spread.join(quart, F.col("__by").eqNullSafe(F.col("__qb")))
        .select(F.col("__by").alias("__bb"), "__n", (0.9 * low * F.pow("__n", F.lit(-0.2))).alias("__h"))
    )
    node = F.floor(F.col("__cell") / CELLS)
    nodes = (
        cells.groupBy("__by", node.alias("i")).agg((F.sum("n") - F.sum("right")).alias("l"), F.sum("right").alias("r"))
        .groupBy("__by").agg(F.collect_list(F.struct("i", "l", "r")).alias("__nodes"))
    )

    def kernel(at: Column, i: Column) -> Column:
        z = (at - (lo + i * step)) / F.col("__h")
        return F.exp(-0.5 * z * z)

    def height(g: Column) -> Column:
        at = lo + g * gap
        total = F.aggregate("__nodes", F.lit(0.0), lambda t, w: t + w["l"] * kernel(at, w["i"]) + w["r"] * kernel(at, w["i"] + 1))
        return total / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi))

    heights = nodes.join(width, F.col("__by").eqNullSafe(F.col("__bb"))).select(
        F.col("__by").alias(by), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), height)).alias("__g", "density")
    )
    return heights.select(by, (lo + F.col("__g") * gap).alias("x"), "density")
