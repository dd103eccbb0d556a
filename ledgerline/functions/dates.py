"""Date helpers (FN-1..8)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ._util import col_of


def first_of_month(c) -> Column:
    """Truncate a date/timestamp to the first day of its month, as DATE."""
    return F.trunc(F.to_date(col_of(c)), "month")


def iso_weekday(c) -> Column:
    """ISO day of week: Monday=1 … Sunday=7."""
    return (F.weekday(col_of(c)) + F.lit(1)).cast("int")


# Shape of the common formats: a cheap regex check picks the format before
# parsing, so the parser is not asked (and does not fail) for other shapes.
_SHAPES = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "dd.MM.yyyy": r"^\d{2}\.\d{2}\.\d{4}$",
    "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
}


def parse_date_any(c, formats=("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")) -> Column:
    """First format that parses wins; unparseable text -> NULL (never raises)."""
    s = F.trim(col_of(c).cast("string"))
    parsed = [F.when(s.rlike(_SHAPES[f]), F.try_to_date(s, f)) if f in _SHAPES else F.try_to_date(s, f)
              for f in formats]
    return F.coalesce(*parsed)


def parse_year_month(c) -> Column:
    """``YYYY-M`` / ``YYYY-MM`` text -> first of month; bad year/month -> NULL."""
    s = F.trim(col_of(c).cast("string"))
    parts = F.split(s, "-")
    y = F.try_element_at(parts, F.lit(1)).try_cast("int")
    m = F.try_element_at(parts, F.lit(2)).try_cast("int")
    ok = (F.size(parts) == 2) & y.between(1, 9999) & m.between(1, 12)
    return F.when(ok, F.make_date(y, m, F.lit(1)))


def first_listed_date(c, formats=("yyyy-MM-dd", "dd.MM.yyyy")) -> Column:
    """First entry of a comma list, trimmed and parsed."""
    first = F.trim(F.split(col_of(c).cast("string"), ",").getItem(0))
    return parse_date_any(first, formats)


def month_label(c, short_year: bool = False) -> Column:
    """``Mon YYYY`` / ``Mon YY`` label; a display column, never a sort key."""
    return F.date_format(col_of(c), "MMM yy" if short_year else "MMM yyyy")


def parse_instant(c) -> Column:
    """ISO-8601 text with an offset (``2025-01-15T10:30:00+03:00``) -> instant;
    bad text -> NULL. With the session in UTC the result is the UTC instant."""
    return F.try_to_timestamp(F.trim(col_of(c).cast("string")))


def local_date(instant, tz: str) -> Column:
    """Calendar date of an instant in a given zone (e.g. the clinic's)."""
    return F.to_date(F.from_utc_timestamp(col_of(instant), tz))
