"""Presentation columns (FN-22, FN-23). Optional, applied last."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ._util import col_of


def fmt_money(c, scale: str = "auto", digits: int = 0) -> Column:
    """Money with space thousands separators, scaled to millions/thousands
    ("1 млн ₽", "350 тыс ₽", "999 ₽"), ``digits`` decimals each; dash for NULL."""
    v = col_of(c).cast("double")
    a = F.abs(v)
    mln = F.concat(F.format_number(v / 1e6, digits), F.lit(" млн ₽"))
    ths = F.concat(F.format_number(v / 1e3, digits), F.lit(" тыс ₽"))
    raw = F.concat(F.format_number(v, digits), F.lit(" ₽"))
    out = (F.when(a >= 1e6, mln).when(a >= 1e3, ths).otherwise(raw)) if scale == "auto" else raw
    return F.when(v.isNull(), F.lit("—")).otherwise(F.regexp_replace(out, ",", " "))


def fmt_pct(c, digits: int = 1) -> Column:
    v = col_of(c).cast("double")
    return F.when(v.isNull(), F.lit("—")).otherwise(F.concat(F.format_number(v, digits), F.lit("%")))


def fmt_delta(c, digits: int = 1) -> Column:
    """Delta with an arrow for its sign: ▲ 3.2% / ▼ 1.0% / ● 0.0%."""
    v = col_of(c).cast("double")
    arrow = F.when(v > 0, F.lit("▲ ")).when(v < 0, F.lit("▼ ")).otherwise(F.lit("● "))
    return F.when(v.isNull(), F.lit("—")).otherwise(F.concat(arrow, F.format_number(F.abs(v), digits), F.lit("%")))


def fill_template(template: str, value) -> Column:
    """printf-style template with one numeric slot."""
    return F.format_string(template, col_of(value).cast("double"))
