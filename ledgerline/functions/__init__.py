"""Column -> Column helpers (FN-*). All are native Spark expressions: they stay
inside whole-stage code generation; no Python UDF anywhere."""

from .dates import (first_of_month, iso_weekday, parse_date_any, parse_year_month, parse_instant, local_date,
                    first_listed_date, month_label)
from .text import (trim_unicode, patient_hash, clip_text, flag_equals,
                   classify_by_rules, ilike_any)
from .numeric import (safe_div, pct_change, signed_by_direction, to_money,
                      money_double, band, monthly_growth_factor)
from .display import fmt_money, fmt_pct, fmt_delta, fill_template

__all__ = [
    "first_of_month", "iso_weekday", "parse_date_any", "parse_year_month", "parse_instant", "local_date",
    "first_listed_date", "month_label", "trim_unicode", "patient_hash", "clip_text",
    "flag_equals", "classify_by_rules", "ilike_any", "safe_div", "pct_change",
    "signed_by_direction", "to_money", "money_double", "band", "monthly_growth_factor",
    "fmt_money", "fmt_pct", "fmt_delta", "fill_template",
]
