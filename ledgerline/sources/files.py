"""Flat-file ingest (SRC-1, 2, 5, 6, 7; FIL-1, FIL-10; PRJ-1; DQ-2, DQ-6).

Files are read with an all-string schema (no inference); typing is done with
``try_cast`` / ``try_to_date`` so a bad value becomes NULL instead of failing
the job under ANSI mode. Each ingest accepts a path or a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions import patient_hash, parse_date_any, first_listed_date, to_money, clip_text, trim_unicode
from ..schemas import all_strings

DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss")


def read_flat(spark: SparkSession, path: str, columns, fmt: str = "csv", **options) -> DataFrame:
    """Read CSV (header row) / Parquet / JSON lines with every column as text,
    tagged with the source file name."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True).schema(all_strings(columns))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path).withColumn("source_file", F.col("_metadata.file_name"))


def rename_available(df: DataFrame, mapping: dict) -> DataFrame:
    """PRJ-1: rename by dictionary, only the columns present."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def _ensure(df: DataFrame, cols) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else df


def transactions_typed(raw: DataFrame, rename: dict = vocab.TRANSACTION_COLUMNS) -> DataFrame:
    """SRC-1 before the reject filter: renamed, typed, patient pseudonymised
    (the clear name is dropped here and never written)."""
    df = _ensure(rename_available(raw, rename), list(rename.values()))
    out = df.select(
        parse_date_any("transaction_date", DATE_FORMATS).alias("transaction_date"),
        trim_unicode("clinic").alias("clinic"),
        patient_hash("patient_name").alias("patient_hash"),
        F.trim(F.col("patient_age")).try_cast("double").try_cast("int").alias("patient_age"),
        trim_unicode("age_group").alias("age_group"),
        trim_unicode("payment_type").alias("payment_type"),
        trim_unicode("operation_type").alias("operation_type"),
        trim_unicode("invoice_clinic").alias("invoice_clinic"),
        to_money("invoice_amount").alias("invoice_amount"),
        to_money("invoice_debt").alias("invoice_debt"),
        F.col("invoice_status"),
        clip_text("service_items").alias("service_items"),
        first_listed_date("visit_dates", DATE_FORMATS).alias("visit_date"),
        F.col("visit_reasons"),
        trim_unicode("doctor_name").alias("doctor_name"),
        trim_unicode("visit_status").alias("visit_status"),
        to_money("transaction_amount").alias("transaction_amount"),
    )
    return out


def split_rejects(typed: DataFrame, required=("transaction_date", "transaction_amount")):
    """FIL-1 / DQ-2: (good, rejects); a reject misses a required value."""
    ok = None
    for c in required:
        cond = F.col(c).isNotNull()
        ok = cond if ok is None else ok & cond
    return typed.where(ok), typed.where(~ok)


def ingest_transactions(raw: DataFrame, rename: dict = vocab.TRANSACTION_COLUMNS) -> DataFrame:
    """SRC-1: typed transactions without the rejected rows."""
    return split_rejects(transactions_typed(raw, rename))[0]


def reject_counts(typed: DataFrame, required=("transaction_date", "transaction_amount")) -> DataFrame:
    """DQ-2: total, rejected and per-reason NULL counts in one aggregate."""
    bad = None
    for c in required:
        b = F.col(c).isNull()
        bad = b if bad is None else bad | b
    return typed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("rejected"),
                     *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required])


def ingest_cf_entries(raw: DataFrame, rename: dict = vocab.CF_ENTRY_COLUMNS, source_file: str | None = None) -> DataFrame:
    """SRC-2: cash-flow journal — renamed (available columns), day-first dates,
    decimal amount, rows without an amount dropped, tagged with the file."""
    df = _ensure(rename_available(raw, rename), list(rename.values()))
    tag = F.lit(source_file) if source_file is not None else (
        F.col("source_file") if "source_file" in df.columns else F.lit(None).cast("string"))
    out = df.select(
        "entry_type", "direction", F.trim("month_num").try_cast("int").alias("month_num"),
        parse_date_any("entry_date", ("dd.MM.yyyy", "yyyy-MM-dd")).alias("entry_date"),
        "document", "description", "debit_account", "credit_account",
        to_money("amount").alias("amount"), "counterparty", "branch_uu", "account_uu", "expense_category",
        tag.alias("source_file"))
    return out.where(F.col("amount").isNotNull())


def ingest_cost_structure(raw: DataFrame, rename: dict = vocab.COST_COLUMNS) -> DataFrame:
    """SRC-5: unit costs — numerics coerced, rows without name/price or with a
    non-positive price dropped; material share, margin and margin share derived."""
    df = _ensure(rename_available(raw, rename), list(rename.values()))
    num = {c: to_money(c, 10, 2) for c in ["price", "material_cost", "doctor_pay", "assistant_pay", "taxes", "total_cost"]}
    df = df.withColumns(num).withColumn("service_name", trim_unicode("service_name"))
    df = df.where(F.col("service_name").isNotNull() & (F.length("service_name") > 0)
                  & F.col("price").isNotNull() & (F.col("price") > 0))
    return df.select(
        "service_code", "service_name", "price", "material_cost", "doctor_pay", "assistant_pay", "taxes", "total_cost",
        F.try_divide(F.col("material_cost").cast("double"), F.col("price").cast("double")).alias("material_pct"),
        (F.col("price") - F.col("total_cost")).alias("margin_rub"),
        F.try_divide((F.col("price") - F.col("total_cost")).cast("double"), F.col("price").cast("double")).alias("margin_pct"))


def unpivot_leads(wide: DataFrame, year=None, label_col: str = vocab.LEAD_LABEL_COLUMN,
                  months=vocab.MONTH_NAMES, keep=vocab.LEAD_TYPES) -> DataFrame:
    """SRC-6: wide month columns -> (year, month, lead_type, count); total and
    unknown rows skipped, empty cells dropped. ``year``: a column name in
    ``wide`` or a fixed value."""
    ycol = F.col(year) if isinstance(year, str) and year in wide.columns else F.lit(year)
    base = wide.where(F.col(label_col).isin(list(keep))).select(
        ycol.cast("int").alias("year"), F.col(label_col).alias("lead_type"),
        *[F.col(m).try_cast("double").alias(m) for m in months])
    long = base.unpivot(["year", "lead_type"], list(months), "month_name", "value").where(F.col("value").isNotNull())
    month_no = F.array_position(F.array(*[F.lit(m) for m in months]), F.col("month_name")).cast("int")
    return long.select("year", month_no.alias("month"), "lead_type", F.col("value").cast("int").alias("count"))


def lead_sources_weekly(wide: DataFrame, source_col: str = "source", sep: str = "/") -> DataFrame:
    """SRC-7: weekly source sheet (one column per week, header
    ``start{sep}end``) -> (source, week_start, week_end, count)."""
    weeks = [c for c in wide.columns if c != source_col]
    long = wide.unpivot([source_col], weeks, "week", "value").where(F.col("value").isNotNull())
    parts = F.split("week", sep)
    return long.select(F.col(source_col).alias("source"),
                       F.try_to_date(parts.getItem(0), "yyyy-MM-dd").alias("week_start"),
                       F.try_to_date(parts.getItem(1), "yyyy-MM-dd").alias("week_end"),
                       F.col("value").try_cast("int").alias("count"))
