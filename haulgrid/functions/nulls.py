"""Expressions that keep missing values the way the freight analyses expect them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_set(c: Column | str, *values) -> Column:
    """Membership that is never NULL: a missing value is simply not in the set, so ``~in_set`` keeps it."""
    if not values:
        return F.lit(False)
    return F.coalesce(as_col(c).isin(*values), F.lit(False))


def strict_sum(c: Column | str) -> Column:
    """Aggregate: NULL as soon as one row is NULL, 0 for no rows."""
    c = as_col(c)
    return F.when(F.count(F.lit(1)) == 0, F.lit(0)).when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def lenient_sum(c: Column | str) -> Column:
    """Aggregate: missing rows count as 0."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division whose result is NULL where the denominator is 0."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def number(c: Column | str, dtype: str = "double") -> Column:
    """Text to number; whatever is not a number becomes NULL."""
    return as_col(c).try_cast(dtype)


def coalesce_max(*cols: Column | str) -> Column:
    """Row-wise maximum over the values that are present."""
    return F.greatest(*[as_col(c) for c in cols])


def row_sum(*cols: Column | str, skip_null: bool = False) -> Column:
    """Row-wise sum; NULL if one term is, unless ``skip_null``."""
    terms = [as_col(c) for c in cols]
    if skip_null:
        terms = [F.coalesce(t, F.lit(0)) for t in terms]
    return reduce(lambda a, b: a + b, terms)
