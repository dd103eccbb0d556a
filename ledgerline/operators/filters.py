"""Row filters (FIL-2, FIL-3, FIL-8, FIL-9, SRC-17)."""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def filter_period(df: DataFrame, lo=None, hi=None, col: str = "year_month") -> DataFrame:
    """Closed range on a month/date column. Written straight on the column so
    Parquet statistics and partition pruning apply."""
    c = F.col(col)
    if lo is not None:
        df = df.where(c >= F.lit(lo))
    if hi is not None:
        df = df.where(c <= F.lit(hi))
    return df


def filter_year(df: DataFrame, year: int, col: str = "year_month") -> DataFrame:
    """Calendar-year filter as a date range (prunes, unlike ``year(col) = y``)."""
    return filter_period(df, _dt.date(year, 1, 1), _dt.date(year, 12, 31), col)


def filter_members(df: DataFrame, **members) -> DataFrame:
    """Set membership per column: ``filter_members(df, branch_name=[...])``."""
    for col, values in members.items():
        if values is not None:
            df = df.where(F.col(col).isin(list(values)))
    return df


def branch_scoped_view(df: DataFrame, branch_id, col: str = "branch_id") -> DataFrame:
    """Row-level scope: only the rows of one branch (or a list of branches)."""
    ids = branch_id if isinstance(branch_id, (list, tuple, set)) else [branch_id]
    return df.where(F.col(col).isin(list(ids)))


def param_filter(df: DataFrame, date_col: str | None = None, date_from=None, date_to=None,
                 contains: dict | None = None, **equals) -> DataFrame:
    """Optional-predicate builder of the source API: inclusive date range,
    equality per parameter (None = not given), case-insensitive substring."""
    preds = []
    if date_col and date_from is not None:
        preds.append(F.col(date_col) >= F.lit(date_from))
    if date_col and date_to is not None:
        preds.append(F.col(date_col) <= F.lit(date_to))
    for col, v in equals.items():
        if v is not None:
            preds.append(F.col(col) == F.lit(v))
    for col, needle in (contains or {}).items():
        if needle:
            preds.append(F.lower(F.col(col)).contains(needle.lower()))
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df
