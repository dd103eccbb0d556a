"""Numeric helpers (FN-9, 14..17, 21)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ._util import col_of


def safe_div(a, b) -> Column:
    """a / b as double, NULL when b is 0 or NULL (ANSI-safe)."""
    return F.try_divide(col_of(a).cast("double"), col_of(b).cast("double"))


def pct_change(cur, base) -> Column:
    """(cur / base - 1) * 100, NULL when the base is 0/NULL."""
    return (safe_div(cur, base) - F.lit(1.0)) * F.lit(100.0)


def signed_by_direction(amount, direction, inflow: str = "inflow") -> Column:
    a = col_of(amount)
    return F.when(col_of(direction) == F.lit(inflow), a).otherwise(-a)


def to_money(c, precision: int = 15, scale: int = 2) -> Column:
    """Text/number -> decimal(p,s); bad values -> NULL."""
    return F.trim(col_of(c).cast("string")).try_cast(f"decimal({precision},{scale})")


def money_double(c) -> Column:
    """Exact decimal sum rendered as double at the very end."""
    return col_of(c).cast("double")


def band(c, edges, labels) -> Column:
    """Banding: value < edges[i] -> labels[i]; otherwise labels[-1]."""
    c = col_of(c)
    expr = None
    for e, lab in zip(edges, labels):
        expr = F.when(c < F.lit(e), F.lit(lab)) if expr is None else expr.when(c < F.lit(e), F.lit(lab))
    return expr.when(c.isNotNull(), F.lit(labels[-1]))


def monthly_growth_factor(annual_pct) -> Column:
    """(1 + g/100) ** (1/12)."""
    return F.pow(F.lit(1.0) + col_of(annual_pct) / F.lit(100.0), F.lit(1.0 / 12.0))
