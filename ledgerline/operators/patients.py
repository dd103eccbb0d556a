"""Distinct patients that add up: bitmaps per month and branch (AGG-9).

Monthly distinct counts can't be summed to those of a quarter. A bitmap per
month, branch and bucket of patient numbers can: any period or set of branches
is the union of its bitmaps, and its bits are the distinct patients. The fact
is read when the bitmaps are made, and by no report after that.

A bitmap covers 32,768 numbers in 4 KB whether full or not. Patients are
numbered by their home branch, so those of a branch share buckets and most
bitmaps of other branches don't exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._order import ranked


def patient_numbers(fact: DataFrame) -> DataFrame:
    """(patient_hash, number): dense numbers from 0, by home branch (the smallest), without one task that numbers all."""
    known = fact.where(F.col("patient_hash").isNotNull()).groupBy("patient_hash").agg(F.min("branch_id").alias("home"))
    numbered = ranked(known, [F.asc_nulls_first("home"), F.asc("patient_hash")], "number")
    return numbered.select("patient_hash", (F.col("number") - 1).alias("number"))


def patient_bitmaps(fact: DataFrame, numbers: DataFrame, keys=("year_month", "branch_id")) -> DataFrame:
    """keys, bucket, bits: who of the bucket has a row in the group. Each patient of a group meets their number once."""
    each = fact.where(F.col("patient_hash").isNotNull()).select(*keys, "patient_hash").distinct().join(numbers, "patient_hash")
    return each.groupBy(*keys, F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def distinct_patients(bitmaps: DataFrame, keys=(), name: str = "distinct_patients") -> DataFrame:
    """Distinct patients of the (filtered) bitmaps per ``keys``; with none, one row."""
    merged = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias(name))
