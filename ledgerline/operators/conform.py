"""Conforming and dimension management (DIM-1..7, JN-6..9, SNK-3, SET-2).

Lookups are left joins to small dimension frames; alias and seed tables are
bounded by the vocabulary and carry a broadcast hint, dimensions that grow
with the data are left to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._joins import bounded_broadcast
from ._order import ranked

from .. import vocab
from ..functions import trim_unicode, classify_by_rules, flag_equals, first_of_month, parse_year_month


def resolve_branch(df: DataFrame, text_col: str, aliases: DataFrame, dim_branch: DataFrame,
                   out_col: str = "branch_id") -> DataFrame:
    """JN-6: two-hop lookup alias -> code -> id; the text is trimmed first,
    unmatched stays NULL. ``aliases``: (alias, code), bounded by the vocabulary."""
    a = bounded_broadcast(aliases.select(trim_unicode("alias").alias("_alias"), "code").dropDuplicates(["_alias"]))
    ids = bounded_broadcast(dim_branch.select("code", F.col("branch_id").alias(out_col)))
    j = df.withColumn("_alias", trim_unicode(text_col)).join(a, "_alias", "left").join(ids, "code", "left")
    return j.drop("_alias", "code")


def lookup_id(df: DataFrame, col: str, dim: DataFrame, dim_key: str, dim_id: str, out_col: str,
              bounded: bool = False) -> DataFrame:
    """JN-7: one-hop name -> id lookup on a trimmed key."""
    d = dim.select(F.col(dim_key).alias("_k"), F.col(dim_id).alias(out_col)).dropDuplicates(["_k"])
    d = bounded_broadcast(d) if bounded else d
    return df.withColumn("_k", trim_unicode(col)).join(d, "_k", "left").drop("_k")


def conform_fact(tx: DataFrame, aliases: DataFrame, dim_branch: DataFrame, payment_types: DataFrame,
                 doctors: DataFrame, payment_label: str = vocab.SOURCE_PAYMENT_LABEL,
                 refund_label: str = vocab.SOURCE_REFUND_LABEL, child_label: str = vocab.SOURCE_CHILD_LABEL,
                 primary_label: str = vocab.SOURCE_PRIMARY_LABEL) -> DataFrame:
    """DIM-3: ingested transactions -> fact rows: branch and invoice branch via
    aliases, payment type and doctor ids, flags (NULL passes through), service
    name, operation code. Names are trimmed on *both* sides before matching."""
    f = resolve_branch(tx, "clinic", aliases, dim_branch, "branch_id")
    f = resolve_branch(f, "invoice_clinic", aliases, dim_branch, "invoice_branch_id")
    f = lookup_id(f, "payment_type", payment_types, "name", "payment_type_id", "payment_type_id", bounded=True)
    f = lookup_id(f, "doctor_name", doctors, "full_name", "doctor_id", "doctor_id", bounded=True)
    op = trim_unicode("operation_type")
    return f.select(
        "transaction_date", first_of_month("transaction_date").alias("year_month"), "branch_id", "patient_hash",
        "patient_age", flag_equals("age_group", child_label).alias("is_child"), "payment_type_id",
        F.when(op == payment_label, F.lit(vocab.PAYMENT)).when(op == refund_label, F.lit(vocab.REFUND))
        .otherwise(op).alias("operation_type"),
        "invoice_branch_id", "invoice_amount", "invoice_debt", F.col("service_items").alias("service_name"),
        "visit_date", "doctor_id", flag_equals("visit_status", primary_label).alias("is_primary_visit"),
        "transaction_amount")


def _keyed(dim: DataFrame, key: str, id_col: str, to: str) -> DataFrame:
    """(_key, to) with one row a key, the smallest id; broadcast while it is small, so that the fact isn't moved."""
    return bounded_broadcast(dim.where(F.col(key).isNotNull()).groupBy(trim_unicode(key).alias("_key")).agg(F.min(id_col).alias(to)))


def conform_api_fact(flat: DataFrame, dim_branch: DataFrame, payment_types: DataFrame, dim_service: DataFrame, dim_doctor: DataFrame) -> DataFrame:
    """DIM-6: flattened API transactions -> fact rows with the ids of our own dimensions.

    The API's ids are its own, so each reference is looked up by what both sides
    know: the branch by code, the payment type by code (``payment_types``: code,
    payment_type_id), the first service and the doctor by name. What a dimension
    doesn't know is NULL, as in ``conform_fact``, for DQ to count.
    """
    f = flat
    for column, dim, key, id_col in (("branch_code", dim_branch, "code", "branch_id"), ("payment_type_code", payment_types, "code", "payment_type_id"),
                                     ("service_name", dim_service, "name", "service_id"), ("doctor_name", dim_doctor, "full_name", "doctor_id")):
        f = f.withColumn("_key", trim_unicode(column)).join(_keyed(dim, key, id_col, id_col), "_key", "left").drop("_key")
    return f.select(
        "transaction_date", first_of_month("transaction_date").alias("year_month"), "branch_id",
        F.col("patient_id").alias("patient_hash"), "patient_age", "is_child", "payment_type_id", "operation_type",
        F.col("invoice_total_amount").alias("invoice_amount"), "invoice_debt", "service_id", "service_name", "visit_date",
        "doctor_id", "is_primary_visit", F.col("amount").alias("transaction_amount"))


def conform_cf_entries(entries: DataFrame, aliases: DataFrame, dim_branch: DataFrame) -> DataFrame:
    """DIM-4: journal entries get a branch id from the branch text."""
    return resolve_branch(entries, "branch_uu", aliases, dim_branch, "branch_id")


def cf_monthly_conform(svod: DataFrame, entity_map: DataFrame) -> DataFrame:
    """DIM-5: consolidated grid rows -> monthly cash-flow fact: month parsed
    from ``YYYY-M``, legal entity mapped by short name (inner: unmapped rows
    are dropped), rows with an unparseable month dropped."""
    m = bounded_broadcast(entity_map.select(F.col("short_name").alias("legal_entity"), "legal_entity_id"))
    j = svod.join(m, "legal_entity", "inner")
    return (j.select(parse_year_month("year_month_str").alias("year_month"), "legal_entity_id",
                     F.lit(None).cast("int").alias("branch_id"), "line_item", "amount", "source_file")
            .where(F.col("year_month").isNotNull()))


def cf_clinics_conform(clinics: DataFrame, aliases: DataFrame, dim_branch: DataFrame) -> DataFrame:
    """DIM-5: per-branch grid rows -> monthly cash-flow fact with branch ids.

    The month is the ``YYYY_MM`` (or ``YYYY-MM``) in the file's name; the branch
    is resolved by alias and brings its legal entity. Rows without a month or
    with an unknown branch are dropped, as unmapped entities are.
    """
    month = F.regexp_extract("source_file", r"(\d{4}[_-](0?[1-9]|1[0-2]))(?!\d)", 1)
    entity = bounded_broadcast(dim_branch.select("branch_id", "legal_entity_id"))
    j = resolve_branch(clinics, "branch", aliases, dim_branch, "branch_id").join(entity, "branch_id", "inner")
    return (j.select(parse_year_month(F.translate(month, "_", "-")).alias("year_month"), "legal_entity_id", "branch_id",
                     "line_item", "amount", "source_file")
            .where(F.col("year_month").isNotNull()))


def expense_hierarchy(lines: DataFrame, expense_types: DataFrame, name_col: str = "line_item",
                      amount_col: str = "amount") -> DataFrame:
    """DIM-7: lines -> expense type -> category -> parent, totals rolled up
    (parent, category) and ordered by the types' sort order."""
    et = bounded_broadcast(expense_types.select(F.col("name").alias(name_col), "category", "parent_category", "sort_order"))
    j = lines.join(et, name_col, "inner")
    g = j.rollup("parent_category", "category").agg(F.sum(amount_col).alias("amount"),
                                                     F.min("sort_order").alias("sort_order"),
                                                     F.grouping_id().alias("_gid"))
    level = F.when(F.col("_gid") == 3, "total").when(F.col("_gid") == 1, "parent").otherwise("category")
    return g.select("parent_category", "category", level.alias("level"), "amount", "sort_order") \
        .orderBy(F.col("sort_order").asc_nulls_last(), "level")


def new_members(incoming: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """JN-9 / SET-2: distinct trimmed incoming keys absent from the dimension."""
    dk = dim_key or key
    inc = incoming.select(trim_unicode(key).alias(key)).where(F.col(key).isNotNull() & (F.length(key) > 0)).distinct()
    return inc.join(dim.select(trim_unicode(dk).alias(key)), key, "left_anti")


def upsert_dimension(incoming: DataFrame, dim: DataFrame, key: str, id_col: str, dim_key: str | None = None,
                     rules=None, default: str | None = None, id_mode: str = "sequential") -> DataFrame:
    """DIM-1/2 + SNK-3: the dimension with unseen names inserted.

    ``id_mode='sequential'``: new ids = max(existing id) + rank of the new name,
    from range-partitioned counts (``ranked``), so that no task sees all new
    names; ``'hash'``: ids from ``xxhash64`` of the natural key, no coordination
    at all.
    ``rules``/``default`` classify new names (FN-13) into ``category``."""
    dk = dim_key or key
    new = new_members(incoming, dim, key, dk)
    if id_mode == "hash":
        new = new.withColumn(id_col, F.xxhash64(key))
    else:
        top = dim.agg(F.max(id_col).alias("_max"))
        new = ranked(new, [F.asc(key)], "_rk")
        new = new.withColumn(id_col, (F.col("_rk") + F.coalesce(top.scalar(), F.lit(0))).cast(dim.schema[id_col].dataType)).drop("_rk")
    if rules is not None:
        new = new.withColumn("category", classify_by_rules(key, rules, default))
    new = new.withColumnRenamed(key, dk) if dk != key else new
    return (dim.withColumn("is_new", F.lit(False))
            .unionByName(new.withColumn("is_new", F.lit(True)), allowMissingColumns=True))
