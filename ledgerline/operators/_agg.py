"""Aggregate building blocks with report (pandas-like) semantics.

* ``psum``: a sum over only missing values is 0, not NULL.
* ``dmean``: mean of an exact DECIMAL column as (exact sum) / (non-null count).
* ``fmean``: mean of a double column, rounded to 6 decimals so the result does
  not depend on the order partial sums are combined in.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ROUND = 6


def c_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def psum(c) -> Column:
    return F.coalesce(F.sum(c_(c)), F.lit(0))


def dmean(c) -> Column:
    return F.try_divide(F.sum(c_(c)).cast("double"), F.count(c_(c)).cast("double"))


def fmean(c) -> Column:
    return F.round(F.avg(c_(c)), ROUND)


def ratio(a, b, scale: float = 1.0) -> Column:
    """a / b (as double) x scale; NULL for a 0/NULL base."""
    r = F.try_divide(c_(a).cast("double"), c_(b).cast("double"))
    return r if scale == 1.0 else r * F.lit(scale)


def r6(c) -> Column:
    return F.round(c_(c), ROUND)
