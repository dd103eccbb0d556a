"""Incremental mart refresh (SNK-2, INC-3).

Only months touched by a delta are recomputed: the fact and cash-flow inputs
are semi-joined with the touched months (on a month-partitioned table this is
dynamic partition pruning), the mart is rebuilt for those months and written
with dynamic partition overwrite, so untouched month partitions are not
rewritten. A changed record can move between months, so the touched set is
built from the old *and* the new version of changed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import first_of_month
from ..sinks import write_mart
from .marts import monthly_pnl, branch_comparison


def touched_months(new_rows: DataFrame, old_rows: DataFrame | None = None,
                   date_col: str = "transaction_date") -> DataFrame:
    m = new_rows.select(first_of_month(date_col).alias("year_month"))
    if old_rows is not None:
        m = m.unionByName(old_rows.select(first_of_month(date_col).alias("year_month")))
    return m.where(F.col("year_month").isNotNull()).distinct()


def refresh_monthly_pnl(fact: DataFrame, cf: DataFrame, dim_branch: DataFrame, months: DataFrame,
                        target: str, patterns: dict | None = None) -> int:
    f = fact.join(months, "year_month", "left_semi")
    c = cf.join(months, "year_month", "left_semi")
    return write_mart(monthly_pnl(f, c, dim_branch, patterns), target)


def refresh_branch_comparison(fact: DataFrame, dim_branch: DataFrame, months: DataFrame, target: str) -> int:
    return write_mart(branch_comparison(fact.join(months, "year_month", "left_semi"), dim_branch), target)
