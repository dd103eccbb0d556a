"""Explicit schemas (never inferred): API records (JSON) and the conformed fact.

Money is DECIMAL as documented; nulls are explicit.
"""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DateType, DecimalType, DoubleType, IntegerType,
                               LongType, MapType, StringType, StructField, StructType, TimestampType)

M15 = DecimalType(15, 2)
M10 = DecimalType(10, 2)
P52 = DecimalType(5, 2)


def S(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


IDNAME = S(("id", IntegerType()), ("name", StringType()))

TRANSACTION = S(
    ("transaction_id", LongType()), ("transaction_date", DateType()), ("transaction_datetime", TimestampType()),
    ("branch", S(("id", IntegerType()), ("name", StringType()), ("code", StringType()))),
    ("patient", S(("id", StringType()), ("age", IntegerType()), ("age_group", StringType()))),
    ("payment_type", S(("code", StringType()), ("name", StringType()))),
    ("operation_type", StringType()),
    ("invoice", S(("id", StringType()), ("branch_id", IntegerType()), ("total_amount", M15), ("debt", M15),
                  ("status", StringType()), ("discount_amount", M15), ("discount_percent", P52))),
    ("services", ArrayType(S(("service_id", IntegerType()), ("code", StringType()), ("name", StringType()),
                             ("category", StringType()), ("quantity", IntegerType()), ("price", M10),
                             ("discount", M10), ("total", M15)))),
    ("doctor", S(("id", IntegerType()), ("name", StringType()), ("specialization", StringType()))),
    ("visit", S(("date", DateType()), ("type", StringType()), ("reason", StringType()))),
    ("amount", M15), ("created_at", TimestampType()), ("updated_at", TimestampType()),
)

DOCTOR = S(
    ("doctor_id", IntegerType()), ("full_name", StringType()), ("short_name", StringType()),
    ("specialization", StringType()), ("additional_specializations", ArrayType(StringType())),
    ("primary_branch", IDNAME), ("branches", ArrayType(IDNAME)), ("is_active", BooleanType()),
    ("hire_date", DateType()), ("updated_at", TimestampType()),
)

SERVICE = S(
    ("service_id", IntegerType()), ("code", StringType()), ("name", StringType()), ("category", StringType()),
    ("subcategory", StringType()), ("base_price", M10),
    ("prices_by_branch", ArrayType(S(("branch_id", IntegerType()), ("branch_name", StringType()), ("price", M10)))),
    ("duration_minutes", IntegerType()), ("is_active", BooleanType()), ("updated_at", TimestampType()),
)

AGE_BUCKETS = ["0_17", "18_30", "31_45", "46_60", "60_plus"]

PATIENT_STATS = S(
    ("period", StringType()), ("branch", IDNAME), ("total_patients", IntegerType()), ("new_patients", IntegerType()),
    ("returning_patients", IntegerType()), ("retention_rate", DoubleType()), ("avg_age", DoubleType()),
    ("age_distribution", S(*[(b, IntegerType()) for b in AGE_BUCKETS])),
    ("avg_visits_per_patient", DoubleType()), ("avg_revenue_per_patient", M15), ("avg_ltv", M15),
)

APPOINTMENT = S(
    ("appointment_id", LongType()), ("date", DateType()), ("time_start", StringType()), ("time_end", StringType()),
    ("duration_minutes", IntegerType()), ("branch", IDNAME),
    ("doctor", S(("id", IntegerType()), ("name", StringType()), ("specialization", StringType()))),
    ("patient", S(("id", StringType()), ("age", IntegerType()), ("age_group", StringType()))),
    ("visit_type", StringType()), ("reason", StringType()), ("status", StringType()), ("source", StringType()),
    ("created_at", TimestampType()), ("updated_at", TimestampType()),
)

BRANCH = S(
    ("branch_id", IntegerType()), ("name", StringType()), ("code", StringType()), ("address", StringType()),
    ("phone", StringType()), ("chairs_count", IntegerType()), ("working_hours", MapType(StringType(), StringType())),
    ("doctors_count", IntegerType()), ("is_active", BooleanType()), ("opened_date", DateType()),
    ("updated_at", TimestampType()),
)

INVOICE = S(
    ("invoice_id", StringType()), ("created_date", DateType()), ("branch", IDNAME),
    ("patient", S(("id", StringType()), ("age_group", StringType()))), ("doctor", IDNAME),
    ("items", ArrayType(S(("service_id", IntegerType()), ("service_name", StringType()), ("quantity", IntegerType()),
                          ("unit_price", M10), ("discount_percent", P52), ("discount_amount", M10), ("total", M15)))),
    ("subtotal", M15), ("discount_total", M15), ("total_amount", M15), ("paid_amount", M15), ("debt", M15),
    ("status", StringType()),
    ("payments", ArrayType(S(("payment_date", DateType()), ("amount", M15), ("payment_type", StringType())))),
    ("created_at", TimestampType()), ("updated_at", TimestampType()),
)

CHANGE_EVENT = S(
    ("event", StringType()), ("timestamp", TimestampType()),
    ("data", S(("transaction_id", LongType()), ("branch_id", IntegerType()), ("amount", M15))),
    ("signature", StringType()),
)


def envelope(record: StructType) -> StructType:
    """Paged response: ``data`` array plus cursor pagination."""
    return S(("page_no", LongType()), ("data", ArrayType(record)),
             ("pagination", S(("cursor", StringType()), ("has_more", BooleanType()), ("total_count", LongType()))))


def synced(paged: StructType) -> StructType:
    """Paged responses of many syncs: ``sync_id`` names the one a page is from."""
    return S(("sync_id", StringType()), *((f.name, f.dataType) for f in paged.fields))


CELLS = S(("source_file", StringType()), ("sheet", StringType()), ("row_idx", IntegerType()),
          ("col_idx", IntegerType()), ("value", StringType()))

FACT_TRANSACTIONS = S(
    ("transaction_date", DateType()), ("year_month", DateType()), ("branch_id", IntegerType()),
    ("patient_hash", StringType()), ("patient_age", IntegerType()), ("is_child", BooleanType()),
    ("payment_type_id", IntegerType()), ("operation_type", StringType()), ("invoice_branch_id", IntegerType()),
    ("invoice_amount", M15), ("invoice_debt", M15), ("service_name", StringType()), ("visit_date", DateType()),
    ("doctor_id", IntegerType()), ("is_primary_visit", BooleanType()), ("transaction_amount", M15),
)


def all_strings(columns) -> StructType:
    """Flat-file read schema: every column text; typing happens in the ingest step."""
    return StructType([StructField(c, StringType(), True) for c in columns])
