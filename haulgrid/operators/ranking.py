"""Exact global ranks, row numbers and batch numbers without a one-partition sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import as_col, ratio
from ..session import materialize, shuffle_partitions
from .skew import attach_by_key, beside

#: Rows a sample for hot values has, and from which share of them a value counts as hot.
SAMPLE, HOT_VALUE = 100_000, 0.005
#: Bits of ``monotonically_increasing_id`` that number the rows of a task.
_PLACE_BITS = 33


def _in_order(df: DataFrame, order: Sequence[str], first_of: str | None = None) -> DataFrame:
    """The rows, written once in global order: ``__bucket`` is the task that wrote a row, ``__place`` its number there from 0.

    Spark's own range partitioning cuts the order by a sample of bounded size, so no split point enters a plan, and the place
    of a row is its position in the sorted task. As the rows are written, both stay what they are in every later read.
    ``first_of``, the only order column, adds ``__first``, the place of the first row with the same value.
    """
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    at, places = F.col("__at"), {"__place": "__at"}
    ranged = ranged.withColumn("__at", F.monotonically_increasing_id())
    if first_of is not None:
        # equal values are in one task already, one after the other
        so_far = Window.partitionBy(first_of).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranged, places = ranged.withColumn("__f", F.min("__at").over(so_far)), places | {"__first": "__f"}
    placed = materialize(ranged, "in-order").withColumn("__bucket", F.shiftright(at, _PLACE_BITS))
    numbers = {k: F.col(c).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) for k, c in places.items()}
    return placed.withColumns(numbers).drop("__at", "__f")


def _with_offset(df: DataFrame, weight: Column) -> DataFrame:
    """Total weight in earlier buckets beside each row; there is one row per bucket to add up."""
    sizes = df.groupBy("__bucket").agg(F.sum(weight).alias("__size"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__bucket", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__offset")
    )
    return df.join(F.broadcast(offsets), "__bucket")


def _ranks(counted: DataFrame, order: Sequence[str]) -> DataFrame:
    """Distinct keys with count ``n``: adds how many rows come before each."""
    inside = Window.partitionBy("__bucket").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        _with_offset(_in_order(counted, order), F.col("n"))
        .withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("__offset"))
        .drop("__bucket", "__place", "__offset")
    )


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Known values with their row count ``n``, written once."""
    counted = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    return materialize(counted, "value-counts")


def group_value_ranks(counted: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Value counts with ``below`` (rows of the group with a smaller value) and ``total`` (its known rows)."""
    ranked = _ranks(counted, [*by, col]).withColumnRenamed("below", "__before")
    groups = ranked.groupBy(*by).agg(
        F.min("__before").alias("__start"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("__values")
    )
    return (
        attach_by_key(ranked, groups, by, "__values")
        .withColumn("below", F.col("__before") - F.col("__start"))
        .drop("__before", "__start")
    )


def _hot_values(values: DataFrame, total: int) -> list:
    """The values (one column) that a sample of bounded size shows to hold a large share of the rows, in order.

    At most 1 / ``HOT_VALUE`` of them; ranks are right whichever are listed, one that is missed only shares a task.
    """
    name = values.columns[0]
    drawn = values.sample(min(1.0, SAMPLE / max(total, 1)), seed=7) if total > SAMPLE else values
    counted = drawn.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    least = max(HOT_VALUE * min(total, SAMPLE), 2)
    return sorted(r[0] for r in counted.filter(F.col("n") >= least).collect())


def _up_to(value: Column, points: list) -> Column:
    """How many of the ascending ``points`` are at most the value, by binary search."""
    if not points:
        return F.lit(0)
    listed = F.array(*[F.lit(p) for p in points])
    steps = F.lit([2**i for i in range(len(points).bit_length() - 1, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(points)) & (F.get(listed, at + step - 1) <= value), at + step
        ).otherwise(at),
    )


def percent_rank_global(df: DataFrame, col: str, out: str = "percent_rank") -> DataFrame:
    """Share of the other known values that are smaller; NULL for missing values and for a lone value.

    Rows are shuffled once, by ranges of values, and ranked where they land: the rank of a value is the position of its first
    row. Values with a large share of the rows (at most 200) are ranked by counts alone and their rows do not move, nor do NULLs.
    """
    rows = materialize(df, "to-rank")
    v = F.col(col)
    known = rows.filter(v.isNotNull())
    hot = _hot_values(known.select(col), known.count())
    number, is_hot = _up_to(v, hot), v.isin(hot) if hot else F.lit(False)
    # rows of each hot value, and of the others between two of them: what lies below a hot value, and what hot rows lie below others
    counts = {
        (r[0], r[1]): r[2] for r in known.groupBy(number.alias("i"), is_hot.alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    total = sum(counts.values())
    hot_below, cold_below = [0], [counts.get((0, False), 0)]
    for i in range(1, len(hot) + 1):
        hot_below.append(hot_below[-1] + counts.get((i, True), 0))
        cold_below.append(cold_below[-1] + counts.get((i, False), 0))

    def share(below: Column) -> Column:
        return ratio(below, F.lit(total - 1)).alias(out)

    def pick(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(x).cast("long") for x in values]), number)

    placed = _in_order(known.filter(~is_hot), [col], first_of=col)
    cold = _with_offset(placed, F.lit(1)).withColumn("__below", F.col("__first") + F.col("__offset") + pick(hot_below))
    parts = [cold.select(*df.columns, share(F.col("__below")))]
    if hot:
        below = [0] + [h + c for h, c in zip(hot_below, cold_below)]
        parts.append(known.filter(is_hot).select(*df.columns, share(pick(below))))
    scored = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return scored.unionByName(rows.filter(v.isNull()).withColumn(out, F.lit(None).cast("double")))


def row_id(df: DataFrame, order: Sequence[Column | str], out: str = "row_num") -> DataFrame:
    """Numbers 1..n in the stated ascending order (negate a number to descend).

    A distributed prefix sum: the rows are written in order, tasks are counted, and a row's number is its place plus
    the rows of earlier tasks. The order must identify rows, else equal rows all meet in one task.
    Where no column does, end it with the ``row_key`` of ``materialize``, which also tells copies apart.
    """
    names = [f"__o{i}" for i in range(len(order))]
    placed = _in_order(df.withColumns({n: as_col(c) for n, c in zip(names, order)}), names)
    return _with_offset(placed, F.lit(1)).select(
        *df.columns, (F.col("__place") + F.col("__offset") + 1).alias(out)
    )


def batch_id(row_num: Column | str, size: int) -> Column:
    """1-based batch of a row number; exact multiples do not open an empty batch."""
    return F.ceil(as_col(row_num) / size).cast("int")


def impute_group_mean(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Missing values become the mean of the known ones of their group; ``missing`` says which."""
    means = df.groupBy(*by).agg(F.avg(col).alias("__avg"), F.count(F.lit(1)).alias("__n"))
    return (
        attach_by_key(df, means, by, "__n")
        .withColumn("missing", F.col(col).isNull())
        .withColumn(col, F.coalesce(F.col(col), F.col("__avg")))
        .drop("__avg")
    )


def share_within(df: DataFrame, by: Sequence[str], col: str, out: str = "share") -> DataFrame:
    """Value over the total of its group; a missing value in the group leaves its shares NULL."""
    totals = df.groupBy(*by).agg(
        F.when(F.count(col) == F.count(F.lit(1)), F.sum(col)).alias("__sum"), F.count(F.lit(1)).alias("__n")
    )
    return attach_by_key(df, totals, by, "__n").withColumn(out, ratio(col, "__sum")).drop("__sum")


def share_of_total(df: DataFrame, col: str, out: str = "share", where: Column | None = None) -> DataFrame:
    """Value over the table total, or over the value of the one row that meets ``where``."""
    total = F.sum(col) if where is None else F.max(F.when(where, F.col(col)))
    return beside(df, df.agg(total.alias("__total"))).withColumn(out, ratio(col, "__total")).drop("__total")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First k rows of each group; each task keeps only its own k before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def order_rank(df: DataFrame, category: str, measure: Column, out: str = "order_rank") -> DataFrame:
    """One row per category with its measure and its place, largest first, ties by name."""
    totals = materialize(df.groupBy(category).agg(measure.alias("measure")), "category-totals")
    return row_id(totals, [-F.col("measure"), category], out)
