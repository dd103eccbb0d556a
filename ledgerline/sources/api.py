"""Nested API records -> flat rows (SRC-8..15).

Records arrive as JSON (landed page files, or a text column) and are parsed
with the explicit schemas of ``ledgerline.schemas`` — never inferred, so money
stays DECIMAL. Nested access is NULL-safe: a missing object gives NULL fields,
a missing/NULL array gives ``services_count = 0``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas as SC


def read_records(spark: SparkSession, path: str, schema: StructType, multiline: bool = False) -> DataFrame:
    """Landed JSON files with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def parse_records(df: DataFrame, text_col: str, schema: StructType) -> DataFrame:
    """JSON text column -> typed struct columns (explicit schema)."""
    return df.select(F.from_json(F.col(text_col), schema).alias("r")).select("r.*")


def _first(arr):
    return F.get(F.col(arr), 0)


def flatten_transactions(rec: DataFrame) -> DataFrame:
    """SRC-8: one flat row per transaction; *first* service only plus count."""
    s = _first("services")
    return rec.select(
        F.col("transaction_id").alias("transaction_id_api"), "transaction_date", "transaction_datetime",
        F.col("branch.id").alias("branch_id_api"), F.col("branch.name").alias("branch_name"),
        F.col("branch.code").alias("branch_code"),
        F.col("patient.id").alias("patient_id"), F.col("patient.age").alias("patient_age"),
        F.col("patient.age_group").alias("patient_age_group"),
        F.col("patient.age_group").eqNullSafe(F.lit("child")).alias("is_child"),
        F.col("payment_type.code").alias("payment_type_code"), F.col("payment_type.name").alias("payment_type_name"),
        "operation_type",
        F.col("invoice.id").alias("invoice_id"), F.col("invoice.total_amount").alias("invoice_total_amount"),
        F.col("invoice.debt").alias("invoice_debt"), F.col("invoice.status").alias("invoice_status"),
        F.col("invoice.discount_amount").alias("invoice_discount_amount"),
        F.col("invoice.discount_percent").alias("invoice_discount_percent"),
        s.getField("service_id").alias("service_id_api"), s.getField("code").alias("service_code"),
        s.getField("name").alias("service_name"), s.getField("category").alias("service_category"),
        s.getField("quantity").alias("service_quantity"), s.getField("price").alias("service_price"),
        s.getField("discount").alias("service_discount"), s.getField("total").alias("service_total"),
        F.coalesce(F.size("services"), F.lit(0)).alias("services_count"),
        F.col("doctor.id").alias("doctor_id_api"), F.col("doctor.name").alias("doctor_name"),
        F.col("doctor.specialization").alias("doctor_specialization"),
        F.col("visit.date").alias("visit_date"), F.col("visit.type").alias("visit_type"),
        F.col("visit.reason").alias("visit_reason"),
        F.col("visit.type").eqNullSafe(F.lit("primary")).alias("is_primary_visit"),
        "amount", "created_at", "updated_at")


def flatten_branches(rec: DataFrame) -> DataFrame:
    """SRC-9: branch directory; opening hours object rendered as JSON text."""
    return rec.select(F.col("branch_id").alias("branch_id_api"), "name", "code", "address", "phone",
                      "chairs_count", "doctors_count", "is_active", "opened_date",
                      F.to_json("working_hours").alias("working_hours"), "updated_at")


def flatten_doctors(rec: DataFrame) -> DataFrame:
    """SRC-10: doctor directory; arrays joined with ", "."""
    return rec.select(
        F.col("doctor_id").alias("doctor_id_api"), "full_name", "short_name", "specialization",
        F.array_join(F.coalesce(F.col("additional_specializations"), F.array()), ", ").alias("additional_specializations"),
        F.col("primary_branch.id").alias("primary_branch_id"), F.col("primary_branch.name").alias("primary_branch_name"),
        F.array_join(F.transform(F.coalesce(F.col("branches"), F.array()), lambda b: b.getField("id").cast("string")),
                     ", ").alias("branch_ids"),
        "is_active", "hire_date", "updated_at")


def flatten_services(rec: DataFrame) -> DataFrame:
    """SRC-11: service catalogue, with the per-branch price list summarised."""
    prices = F.coalesce(F.col("prices_by_branch"), F.array())
    return rec.select(
        F.col("service_id").alias("service_id_api"), "code", "name", "category", "subcategory", "base_price",
        "duration_minutes", "is_active", "updated_at",
        F.size(prices).alias("branch_prices"),
        F.array_min(F.transform(prices, lambda p: p.getField("price"))).alias("min_branch_price"))


def flatten_appointments(rec: DataFrame) -> DataFrame:
    """SRC-12: appointments."""
    return rec.select(
        F.col("appointment_id").alias("appointment_id_api"), "date", "time_start", "time_end", "duration_minutes",
        F.col("branch.id").alias("branch_id_api"), F.col("branch.name").alias("branch_name"),
        F.col("doctor.id").alias("doctor_id_api"), F.col("doctor.name").alias("doctor_name"),
        F.col("doctor.specialization").alias("doctor_specialization"),
        F.col("patient.id").alias("patient_id"), F.col("patient.age").alias("patient_age"),
        F.col("patient.age_group").alias("patient_age_group"),
        "visit_type", "reason", "status", "source", "created_at", "updated_at")


def flatten_invoices(rec: DataFrame) -> DataFrame:
    """SRC-13: invoices with item and payment counts."""
    return rec.select(
        "invoice_id", "created_date", F.col("branch.id").alias("branch_id_api"), F.col("branch.name").alias("branch_name"),
        F.col("patient.id").alias("patient_id"), F.col("patient.age_group").alias("patient_age_group"),
        F.col("doctor.id").alias("doctor_id_api"), F.col("doctor.name").alias("doctor_name"),
        "subtotal", "discount_total", "total_amount", "paid_amount", "debt", "status",
        F.coalesce(F.size("items"), F.lit(0)).alias("items_count"),
        F.coalesce(F.size("payments"), F.lit(0)).alias("payments_count"),
        "created_at", "updated_at")


def flatten_patient_stats(rec: DataFrame) -> DataFrame:
    """SRC-14: patient statistics; the age-bucket object spread to 5 columns."""
    return rec.select(
        "period", F.col("branch.id").alias("branch_id_api"), F.col("branch.name").alias("branch_name"),
        "total_patients", "new_patients", "returning_patients", "retention_rate", "avg_age",
        *[F.col("age_distribution").getField(b).alias(f"age_{b}") for b in SC.AGE_BUCKETS],
        "avg_visits_per_patient", "avg_revenue_per_patient", "avg_ltv")


def explode_pages(pages: DataFrame, keys=()) -> DataFrame:
    """SRC-15: concatenate paged payloads in page order, stopping at the first
    page with no data (excluded) or the first page without ``has_more`` or
    cursor (included). Works on page metadata (one row per page), then keeps
    the pages in range and ``explode`` yields the records.

    ``keys`` name one walk over an endpoint (endpoint, sync): each walk stops
    at its own page. Without keys all pages are one walk."""
    keys = list(keys)
    meta = pages.select(
        *keys, "page_no",
        (F.coalesce(F.size("data"), F.lit(0)) == 0).alias("empty"),
        (~F.coalesce(F.col("pagination.has_more"), F.lit(False)) | F.col("pagination.cursor").isNull()).alias("last"))
    stops = meta.groupBy(*keys).agg(F.min(F.when(F.col("empty"), F.col("page_no"))).alias("first_empty"),
                     F.min(F.when(F.col("last"), F.col("page_no"))).alias("first_last"))
    # last page to keep; ``least`` skips NULLs, NULL = no stop page at all.
    max_page = F.least(F.col("first_empty") - F.lit(1), F.col("first_last"))
    if keys:
        stops = stops.select(*[F.col(k).alias(f"_{k}") for k in keys], max_page.alias("_stop"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        # one row a walk: broadcast, so that pages stay where they were read; by walk, the longest would be one task
        kept = pages.join(F.broadcast(stops), same, "inner").where((F.col("page_no") <= F.col("_stop")) | F.col("_stop").isNull())
    else:
        stop = stops.select(max_page).scalar()
        kept = pages.where((F.col("page_no") <= stop) | stop.isNull())
    return kept.select(*keys, "page_no", F.explode("data").alias("r")).select(*keys, "page_no", "r.*")
