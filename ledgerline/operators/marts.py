"""The four monthly marts and their two building blocks (AGG-1..6, JN-1..4).

Conformed fact columns used here (see ``ledgerline.schemas.FACT_TRANSACTIONS``):
``transaction_date, year_month, branch_id, patient_hash, operation_type,
is_child, is_primary_visit, service_name, doctor_id, transaction_amount``.

Money stays DECIMAL through every sum (exact, order independent); callers cast
to double at the edge. Every aggregate is a hash aggregate with a map-side
partial step, so a branch or month holding a third of all rows is combined
inside each task before the shuffle. Dimension lookups happen *after*
aggregation, on the small aggregated frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions import ilike_any
from ._joins import lookup_join

def _pay():
    return F.col("operation_type") == F.lit(vocab.PAYMENT)


def _ref():
    return F.col("operation_type") == F.lit(vocab.REFUND)


def _amt():
    return F.col("transaction_amount")


def _sum_if(cond, value=None):
    value = _amt() if value is None else value
    return F.sum(F.when(cond, value))


def _count_if(cond):
    return F.count(F.when(cond, F.lit(1)))


def _avg_if(cond, value=None):
    value = _amt() if value is None else value
    """Mean as exact decimal sum / count, rendered double; NULL when no row."""
    return F.try_divide(_sum_if(cond, value).cast("double"), _count_if(cond).cast("double"))


def branch_patients(fact: DataFrame) -> DataFrame:
    """Distinct patients per month x branch, for marts that share them."""
    pairs = fact.where(F.col("patient_hash").isNotNull()).select("year_month", "branch_id", "patient_hash").distinct()
    return pairs.groupBy("year_month", "branch_id").agg(F.count(F.lit(1)).alias("unique_patients"))


def _with_patients(fact: DataFrame, keys: list[str], aggs: list, approx_rsd: float | None, patients: DataFrame | None = None) -> DataFrame:
    """``aggs`` per ``keys`` with ``unique_patients``: exact or, at very large
    scale, a HyperLogLog++ sketch merged map-side (one shuffle, bounded memory,
    ``approx_rsd`` relative standard deviation).

    Exact, a row counts twice: with its measures and no patient, which each task
    sums to a row per ``keys``, and with its patient and no measures. So what is
    shuffled by patient is ids, not the buffers of all sums for every patient.
    ``patients`` are these counts already made (``branch_patients``)."""
    if patients is not None:
        counts = patients.select(*[F.col(k).alias(f"_{k}") for k in keys], "unique_patients")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        j = fact.groupBy(*keys).agg(*aggs).join(counts, same, "left").drop(*[f"_{k}" for k in keys])
        return j.withColumn("unique_patients", F.coalesce("unique_patients", F.lit(0).cast("long")))
    if approx_rsd:
        return fact.groupBy(*keys).agg(*aggs, F.approx_count_distinct("patient_hash", approx_rsd).alias("unique_patients"))
    measured = F.col("_row._measured")
    measures = [c for c in ("transaction_amount", "operation_type", "is_primary_visit", "is_child") if c in fact.columns]
    two = F.array(F.struct(F.lit(True).alias("_measured"), F.lit(None).cast("string").alias("_patient")),
                  F.struct(F.lit(False).alias("_measured"), F.col("patient_hash").alias("_patient")))
    rows = (fact.select(*keys, *measures, F.explode(two).alias("_row"))
            .select(*keys, *[F.when(measured, F.col(c)).alias(c) for c in measures], "_row.*"))
    per = rows.groupBy(*keys, "_measured", "_patient").agg(*aggs)
    names = [c for c in per.columns if c not in (*keys, "_measured", "_patient")]
    return per.groupBy(*keys).agg(*[F.max(F.when(F.col("_measured"), F.col(c))).alias(c) for c in names],
                                  F.count("_patient").alias("unique_patients"))


def revenue_accrual(fact: DataFrame, approx_patients: float | None = None, patients: DataFrame | None = None) -> DataFrame:
    """AGG-1: accrual revenue per month x branch."""
    return _with_patients(fact, ["year_month", "branch_id"], [
        F.sum(F.when(_pay(), _amt()).otherwise(F.lit(0))).alias("gross_revenue"),
        F.sum(F.when(_ref(), F.abs(_amt())).otherwise(F.lit(0))).alias("refunds"),
        F.sum(_amt()).alias("net_revenue"),
        _count_if(_pay()).alias("payment_count"),
        _count_if(_pay() & (F.col("is_primary_visit") == F.lit(True))).alias("primary_visits"),
        _avg_if(_pay()).alias("avg_ticket"),
    ], approx_patients, patients).select("year_month", "branch_id", "gross_revenue", "refunds", "net_revenue", "unique_patients",
                               "payment_count", "primary_visits", "avg_ticket")


def cf_summary(cf_monthly: DataFrame, patterns: dict | None = None,
               signed=vocab.CF_SIGNED_BUCKETS) -> DataFrame:
    """AGG-2: cash-flow buckets by line-item patterns; buckets overlap and are
    NULL (not 0) when no line of the month matches."""
    patterns = patterns or vocab.CF_PATTERNS_DEFAULT
    amt = F.col("amount")
    aggs = []
    for bucket, pats in patterns.items():
        v = amt if bucket in signed else F.abs(amt)
        aggs.append(F.sum(F.when(ilike_any("line_item", pats), v)).alias(bucket))
    return cf_monthly.groupBy("year_month", "branch_id").agg(*aggs)


PNL_COST_BUCKETS = ["materials", "lab", "payroll_doctors", "payroll_assistants",
                    "rent", "marketing", "it_costs"]


def monthly_pnl(fact: DataFrame, cf_monthly: DataFrame, dim_branch: DataFrame,
                patterns: dict | None = None, approx_patients: float | None = None, patients: DataFrame | None = None) -> DataFrame:
    """AGG-3: accrual revenue FULL OUTER cash buckets on (year_month, branch_id),
    then branch name. A NULL branch never matches, so it stays one-sided."""
    r = revenue_accrual(fact, approx_patients, patients)
    c = cf_summary(cf_monthly, patterns)
    for b in ["cash_revenue"] + PNL_COST_BUCKETS:
        if b not in c.columns:
            c = c.withColumn(b, F.lit(None).cast("decimal(25,2)"))
    j = r.join(c, ["year_month", "branch_id"], "full")
    z = lambda name: F.coalesce(F.col(name), F.lit(0))
    gross_margin = z("net_revenue") - z("materials") - z("lab")
    out = j.select(
        "year_month", "branch_id",
        F.col("net_revenue").alias("revenue_accrual"),
        F.col("cash_revenue").alias("revenue_cash"),
        "gross_revenue", "refunds", "avg_ticket", "unique_patients", "payment_count",
        "primary_visits", "materials", "lab",
        gross_margin.alias("gross_margin"),
        "payroll_doctors", "payroll_assistants",
        (z("payroll_doctors") + z("payroll_assistants")).alias("total_payroll_direct"),
        "rent", "marketing", "it_costs",
        (gross_margin - z("payroll_doctors") - z("payroll_assistants") - z("rent")
         - z("marketing") - z("it_costs")).alias("ebitda"),
    )
    names = dim_branch.select("branch_id", F.col("display_name").alias("branch_name"))
    out = lookup_join(out, names, "branch_id")
    cols = ["year_month", "branch_id", "branch_name"] + [c for c in out.columns
                                                         if c not in ("year_month", "branch_id", "branch_name")]
    return out.select(*cols)


def doctor_kpi(fact: DataFrame, dim_doctor: DataFrame, dim_branch: DataFrame) -> DataFrame:
    """AGG-4: month x doctor x branch KPIs; revenue per distinct paying day
    (at least 1). Rows without a doctor are left out. The days of a month are
    bits of one integer, so patients stay the only distinct count and the fact
    isn't expanded. Few rows share a doctor's month, so they move once, as plain
    columns, and patients and sums are found where they lie. They move by ranges
    of months, doctors and branches: a big month is many tasks, and a mart stored
    by month needs no second move."""
    keys = ["year_month", "doctor_id", "branch_id"]
    paid = F.col("_pays")
    agg = (fact.where(F.col("doctor_id").isNotNull())
           .select(*keys, "patient_hash", _pay().alias("_pays"), F.when(_pay(), _amt()).alias("_paid"),
                   F.when(_pay(), F.expr("shiftleft(1, day(transaction_date) - 1)")).alias("_day"),
                   (_pay() & (F.col("is_primary_visit") == F.lit(True))).alias("_primary"))
           .repartitionByRange(*keys).groupBy(*keys).agg(
               F.sum("_paid").alias("revenue"),
               _count_if(paid).alias("visit_count"),
               F.count_distinct("patient_hash").alias("unique_patients"),
               _count_if(F.col("_primary")).alias("primary_visits"),
               _avg_if(paid, F.col("_paid")).alias("avg_ticket"),
               F.bit_count(F.coalesce(F.bit_or("_day"), F.lit(0))).alias("_days"),
           ))
    agg = agg.withColumn("revenue_per_workday",
                         F.col("revenue").cast("double") / F.greatest(F.col("_days"), F.lit(1)).cast("double")
                         ).drop("_days")
    docs = dim_doctor.select("doctor_id", F.col("full_name").alias("doctor_name"), "specialization")
    names = dim_branch.select("branch_id", F.col("display_name").alias("branch_name"))
    out = lookup_join(lookup_join(agg, docs, "doctor_id"), names, "branch_id")
    return out.select("year_month", "doctor_id", "doctor_name", "specialization", "branch_id",
                      "branch_name", "revenue", "visit_count", "unique_patients",
                      "primary_visits", "avg_ticket", "revenue_per_workday")


def branch_comparison(fact: DataFrame, dim_branch: DataFrame, approx_patients: float | None = None, patients: DataFrame | None = None) -> DataFrame:
    """AGG-5: month x branch comparison with children/adult split."""
    agg = _with_patients(fact, ["year_month", "branch_id"], [
        _sum_if(_pay()).alias("revenue"),
        F.sum(_amt()).alias("net_revenue"),
        _count_if(_pay()).alias("payments"),
        _count_if(_pay() & (F.col("is_primary_visit") == F.lit(True))).alias("primary_visits"),
        _avg_if(_pay()).alias("avg_ticket"),
        _sum_if(_pay() & (F.col("is_child") == F.lit(True))).alias("children_revenue"),
        _sum_if(_pay() & (F.col("is_child") == F.lit(False))).alias("adult_revenue"),
    ], approx_patients, patients)
    names = dim_branch.select("branch_id", F.col("display_name").alias("branch_name"))
    out = lookup_join(agg, names, "branch_id")
    return out.select("year_month", "branch_id", "branch_name", "revenue", "net_revenue",
                      "payments", "unique_patients", "primary_visits", "avg_ticket",
                      "children_revenue", "adult_revenue")


def service_economics(fact: DataFrame, cost_rows: DataFrame, dim_branch: DataFrame,
                      dim_service: DataFrame | None = None, min_payments: int = 5,
                      latest_cost: bool = False) -> DataFrame:
    """AGG-6: service x branch economics joined to unit costs by service *name*.

    Several cost rows with one name fan out and split the group by cost triple
    (source semantics). The fact is pre-aggregated to (service, branch) before
    the join, so the fan-out multiplies a small aggregate, not the fact; the
    re-sum over the fan-out reproduces row-level counting exactly.
    ``latest_cost=True`` keeps one cost row per name (highest effective_date).
    """
    pre = (fact.where(F.col("service_name").isNotNull())
           .groupBy("service_name", "branch_id").agg(
               _count_if(_pay()).alias("_n"), _sum_if(_pay()).alias("_rev")))
    costs = cost_rows.select("service_name", "material_cost", "doctor_pay", "margin_pct",
                             *(["effective_date"] if "effective_date" in cost_rows.columns else []))
    if latest_cost:
        order = "effective_date" if "effective_date" in costs.columns else "material_cost"
        costs = (costs.groupBy("service_name")
                 .agg(F.max_by(F.struct("material_cost", "doctor_pay", "margin_pct"), F.col(order)).alias("c"))
                 .select("service_name", "c.*"))
    else:
        costs = costs.drop("effective_date") if "effective_date" in costs.columns else costs
    return _service_margins(pre.join(costs, "service_name", "left"), dim_branch, dim_service, min_payments)


def service_economics_asof(fact: DataFrame, cost_rows: DataFrame, dim_branch: DataFrame,
                           dim_service: DataFrame | None = None, min_payments: int = 5) -> DataFrame:
    """AGG-6 / JN-4 with the cost in force: every sale is set against the cost row
    of its service with the latest ``effective_date`` up to the sale's date.

    An as-of join: a service's cost history is one row (a sorted array with an
    entry per price change), sales are summed per service, branch and day before
    they meet it, and the entry in force is the last one that isn't later. A cost
    without a date is in force from the beginning; a sale before the first cost
    has none; of two costs of one day the higher one holds.
    """
    pre = (fact.where(F.col("service_name").isNotNull())
           .groupBy("service_name", "branch_id", "transaction_date").agg(
               _count_if(_pay()).alias("_n"), _sum_if(_pay()).alias("_rev")))
    entry = F.struct("effective_date", "material_cost", "doctor_pay", "margin_pct")
    history = cost_rows.groupBy("service_name").agg(F.sort_array(F.collect_set(entry)).alias("_costs"))
    upto = F.filter("_costs", lambda c: c["effective_date"].isNull() | (c["effective_date"] <= F.col("transaction_date")))
    j = (pre.join(history, "service_name", "left").withColumn("_c", F.try_element_at(upto, F.lit(-1)))
         .select("service_name", "branch_id", "_n", "_rev", "_c.material_cost", "_c.doctor_pay", "_c.margin_pct"))
    return _service_margins(j, dim_branch, dim_service, min_payments)


def _service_margins(j: DataFrame, dim_branch: DataFrame, dim_service: DataFrame | None, min_payments: int) -> DataFrame:
    """Sums per service, branch and cost triple over pre-aggregated rows (``_n``, ``_rev``), with names."""
    g = (j.groupBy("service_name", "branch_id", "material_cost", "doctor_pay", "margin_pct")
         .agg(F.sum("_n").alias("service_count"), F.sum("_rev").alias("total_revenue"))
         .where(F.col("service_count") >= F.lit(min_payments))
         .withColumn("avg_price", F.try_divide(F.col("total_revenue").cast("double"),
                                               F.col("service_count").cast("double"))))
    names = dim_branch.select("branch_id", F.col("display_name").alias("branch_name"))
    g = lookup_join(g, names, "branch_id")
    if dim_service is not None:
        g = lookup_join(g, dim_service.select(F.col("name").alias("service_name"), "category"),
                        "service_name")
    cols = ["service_name", "branch_id", "branch_name", "service_count", "total_revenue",
            "avg_price", "material_cost", "doctor_pay", "margin_pct"]
    if dim_service is not None:
        cols.append("category")
    return g.select(*cols)


def mart_order(df: DataFrame, mart: str) -> DataFrame:
    """TOP-1: the source's read order of a mart. Its DESC puts NULLs first, so
    that is kept explicitly. Applied at read time; stored tables are unordered."""
    orders = {
        "monthly_pnl": [F.asc("year_month"), F.asc("branch_id")],
        "doctor_kpi": [F.asc("year_month"), F.desc_nulls_first("revenue")],
        "branch_comparison": [F.asc("year_month"), F.desc_nulls_first("revenue")],
        "service_economics": [F.desc_nulls_first("total_revenue")],
    }
    return df.orderBy(*orders[mart])
