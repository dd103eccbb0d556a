"""Calendar dimension (SRC-18; FN-2, FN-3)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions import iso_weekday


def calendar_from_bounds(bounds: DataFrame, lo: str = "lo", hi: str = "hi", locale: str = "en") -> DataFrame:
    """Every day between the bounds of a one-row frame (e.g. min/max of a fact
    date) with ISO weekday, names, ISO week, month, quarter, year, workday flag
    and ``yyyy-MM``. ``locale='ru'`` takes day and month names from the
    vocabulary instead of the JVM's English names."""
    days = bounds.select(F.explode(F.sequence(F.col(lo), F.col(hi), F.expr("INTERVAL 1 DAY"))).alias("date_id"))
    d = F.col("date_id")
    dow = iso_weekday(d)
    if locale == "ru":
        day_name = F.element_at(F.array(*[F.lit(x) for x in vocab.DAY_NAMES]), dow)
        month_name = F.element_at(F.array(*[F.lit(x) for x in vocab.MONTH_NAMES]), F.month(d))
    else:
        day_name, month_name = F.date_format(d, "EEEE"), F.date_format(d, "MMMM")
    return days.select(
        d, F.dayofmonth(d).alias("day_of_month"), dow.alias("day_of_week"),
        day_name.alias("day_name"), F.weekofyear(d).alias("week_of_year"),
        F.month(d).alias("month_num"), month_name.alias("month_name"),
        F.quarter(d).alias("quarter"), F.year(d).alias("year"), (dow <= 5).alias("is_workday"),
        F.date_format(d, "yyyy-MM").alias("year_month"))


def dim_date(spark: SparkSession, start=_dt.date(2022, 1, 1), end=_dt.date(2027, 12, 31),
             locale: str = "en") -> DataFrame:
    """Fixed calendar range (the source seeds 2022-01-01 .. 2027-12-31)."""
    b = spark.range(1).select(F.lit(start).alias("lo"), F.lit(end).alias("hi"))
    return calendar_from_bounds(b, locale=locale)
