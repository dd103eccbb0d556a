"""Alerts (ALR-1/2) and data-quality checks (DQ-1..6, AGG-25).

Alert rules are data: each rule names a metric expression on the monthly P&L,
a comparison and a threshold; the thresholds are ours (the source defines the
alert record but no rule). Previous-month values are matched by *calendar*
month (self-join on ``add_months``), so a missing month never pairs with an
older one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window, functions as F

from .. import vocab
from ._agg import ratio

# Our default thresholds (percent / percentage points).
ALERT_THRESHOLDS = {
    "margin_drop": 5.0,
    "material_spike": 30.0,
    "revenue_drop": 10.0,
    "low_primary": 45.0,
    "high_refund": 35.0,
    "payroll_overrun": 45.0,
}

ALERT_COLUMNS = ["alert_id", "created_at", "year_month", "branch_id", "branch_name", "doctor_id",
                 "doctor_name", "alert_type", "severity", "metric_name", "metric_value",
                 "threshold_value", "description", "recommendation"]


def _prev(pnl: DataFrame, months: int, cols, suffix: str) -> DataFrame:
    return pnl.select(F.add_months("year_month", months).alias("year_month"), "branch_id",
                      *[F.col(c).alias(c + suffix) for c in cols])


def alert_metrics(pnl: DataFrame, growth_pct: float = 12.0) -> DataFrame:
    """Per month x branch: the six rule metrics."""
    base = pnl.where(F.col("branch_id").isNotNull())
    p1 = _prev(base, 1, ["gross_margin", "revenue_accrual", "materials"], "_p1")
    p12 = _prev(base, 12, ["revenue_accrual"], "_p12")
    j = base.join(p1, ["year_month", "branch_id"], "left").join(p12, ["year_month", "branch_id"], "left")
    gm = ratio("gross_margin", "revenue_accrual", 100.0)
    gm_prev = ratio("gross_margin_p1", "revenue_accrual_p1", 100.0)
    plan = F.col("revenue_accrual_p12").cast("double") * F.lit(1 + growth_pct / 100)
    return j.select(
        "year_month", "branch_id", "branch_name",
        (gm_prev - gm).alias("margin_drop"),
        ((ratio("materials", "materials_p1") - F.lit(1.0)) * F.lit(100.0)).alias("material_spike"),
        ((F.lit(1.0) - ratio(F.col("revenue_accrual").cast("double"), plan)) * F.lit(100.0)).alias("revenue_drop"),
        ratio("primary_visits", "payment_count", 100.0).alias("low_primary"),
        ratio("refunds", "gross_revenue", 100.0).alias("high_refund"),
        ratio("total_payroll_direct", "revenue_accrual", 100.0).alias("payroll_overrun"))


def alerts(pnl: DataFrame, thresholds: dict | None = None, templates=vocab.ALERT_TEMPLATES) -> DataFrame:
    """ALR-1/2: one alert row per (rule, month, branch) that fires.

    One pass: the rule metrics are computed once per month x branch, the rules
    are expanded with ``inline`` (one struct per rule) and filtered."""
    th = dict(ALERT_THRESHOLDS, **(thresholds or {}))
    m = alert_metrics(pnl)
    rules = []
    for a_type, severity, metric_name, desc, advice in templates:
        if a_type not in th:
            continue
        rules.append(F.struct(
            F.lit(a_type).alias("alert_type"), F.lit(severity).alias("severity"),
            F.lit(metric_name).alias("metric_name"), F.col(a_type).cast("double").alias("v"),
            F.lit(float(th[a_type])).alias("threshold_value"), F.lit(desc).alias("tmpl"),
            F.lit(1 if ".1f" in desc else 0).alias("nd"), F.lit(a_type == "low_primary").alias("below"),
            F.lit(advice).alias("recommendation")))
    x = m.select("year_month", "branch_id", "branch_name", F.inline(F.array(*rules)))
    v = F.col("v")
    fires = F.when(F.col("below"), v < F.col("threshold_value")).otherwise(v > F.col("threshold_value"))
    shown = F.when(F.col("nd") == 1, F.round(v, 1)).otherwise(F.round(v, 0))
    out = x.where(fires).withColumn("_shown", shown)
    w = Window.orderBy("year_month", "branch_id", "alert_type")
    return out.select(
        F.row_number().over(w).cast("long").alias("alert_id"),
        F.add_months("year_month", 1).cast("timestamp").alias("created_at"),
        "year_month", "branch_id", "branch_name",
        F.lit(None).cast("int").alias("doctor_id"), F.lit(None).cast("string").alias("doctor_name"),
        "alert_type", "severity", "metric_name", F.round(v, 4).alias("metric_value"), "threshold_value",
        F.expr("format_string(tmpl, _shown)").alias("description"), "recommendation")


def recent_alerts(al: DataFrame, n: int = 6) -> DataFrame:
    """TOP-6: latest n alerts (created_at desc, id as tie-break)."""
    return al.orderBy(F.desc("created_at"), F.desc("alert_id")).limit(n)


def load_profile(df: DataFrame, date_col: str, cols) -> DataFrame:
    """AGG-25 / DQ-1: row count, date range and NULL count per column, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(date_col).alias("min_date"),
                  F.max(date_col).alias("max_date"),
                  *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


def dq_domain(df: DataFrame, col: str, allowed) -> DataFrame:
    """DQ-3: out-of-domain values with their counts (empty when clean)."""
    return (df.where(~F.col(col).isin(list(allowed)) | F.col(col).isNull())
            .groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("rows")))


def dq_orphans(df: DataFrame, checks: dict) -> DataFrame:
    """DQ-4: per foreign key, rows whose non-NULL key has no dimension row
    (anti-join; the dimension side is deduplicated to its keys first)."""
    parts = []
    for fk, (dim, dim_key) in checks.items():
        keys = dim.select(F.col(dim_key).alias(fk)).distinct()
        o = df.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti")
        parts.append(o.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(fk).alias("foreign_key"), "orphans"))
    return reduce(DataFrame.unionByName, parts)


def dq_duplicates(df: DataFrame, keys, name: str) -> DataFrame:
    """DQ-5: natural keys that occur more than once."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
            .select(F.lit(name).alias("table"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
                    "rows"))


def missing_columns(df: DataFrame, expected) -> list[str]:
    """DQ-6: expected columns absent from the frame (schema metadata only)."""
    return [c for c in expected if c not in df.columns]


def checked(df: DataFrame, rules: dict, keys: dict | None = None) -> DataFrame:
    """DQ-2/3/4 in one pass: ``df`` with ``dq_mask``, a bit for each rule that a row breaks.

    ``rules``: name -> Column that is true where the row is bad (null: it isn't);
    ``keys``: name -> (column, dimension, its key), broken by a non-null key that
    the dimension doesn't have. Bits go by the order of ``rules``, then ``keys``.
    The dimensions' keys are joined once each; rows are never split or repeated.
    """
    bits = [F.when(bad, F.lit(1 << i)).otherwise(F.lit(0)) for i, bad in enumerate(rules.values())]
    for i, (column, dim, dim_key) in enumerate((keys or {}).values(), len(bits)):
        known = dim.select(F.col(dim_key).alias(f"_k{i}")).where(F.col(f"_k{i}").isNotNull()).distinct().withColumn(f"_f{i}", F.lit(True))
        df = df.join(known, F.col(column) == F.col(f"_k{i}"), "left")
        bits.append(F.when(F.col(column).isNotNull() & F.col(f"_f{i}").isNull(), F.lit(1 << i)).otherwise(F.lit(0)))
    mask = reduce(lambda a, b: a + b, [b.cast("long") for b in bits])
    return df.withColumn("dq_mask", mask).drop(*[c for c in df.columns if c.startswith(("_k", "_f")) and c[2:].isdigit()])


def quarantine(df: DataFrame, target: str, rules: dict, keys: dict | None = None) -> dict:
    """Check, split and count in one scan of ``df``: rows go to ``target`` in the folders ``dq_bad=true`` and ``dq_bad=false``
    (with their mask), and rows per rule come from ``observe`` in that write: {rule: rows, ..., "quarantined": n, "good": n}."""
    names = [*rules, *(keys or {})]
    seen = Observation("dq")
    marked = checked(df, rules, keys).withColumn("dq_bad", F.col("dq_mask") != 0)
    marked = marked.observe(seen, *[F.count_if(F.col("dq_mask").bitwiseAND(F.lit(1 << i)) != 0).alias(f"r{i}") for i in range(len(names))],
                            F.count_if("dq_bad").alias("quarantined"), F.count_if(~F.col("dq_bad")).alias("good"))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("dq_bad").parquet(target)
    found = seen.get
    return {n: found[f"r{i}"] for i, n in enumerate(names)} | {k: found[k] for k in ("quarantined", "good")}
