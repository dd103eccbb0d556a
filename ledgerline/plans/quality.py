"""Alerts and data-quality checks as registered queries."""

from __future__ import annotations

from .. import vocab
from ..operators import quality as Q
from ..sources.driver import Warehouse
from .registry import query, finish
from . import sqlbase as S
from .sqlbase import ratio


def _wh(spark, sf_dir):
    return Warehouse.of(spark, sf_dir)


def _alerts_sql():
    k = f"CAST('{1 + 12.0 / 100!r}' AS DOUBLE)"
    am = f"""am AS (SELECT b.year_month, b.branch_id, b.branch_name,
  {ratio('p1.gross_margin', 'p1.revenue_accrual', 100.0)} - {ratio('b.gross_margin', 'b.revenue_accrual', 100.0)} AS margin_drop,
  ({ratio('b.materials', 'p1.materials')} - 1.0) * 100.0 AS material_spike,
  (1.0 - {ratio('CAST(b.revenue_accrual AS DOUBLE)', f'CAST(p12.revenue_accrual AS DOUBLE) * {k}')}) * 100.0 AS revenue_drop,
  {ratio('b.primary_visits', 'b.payment_count', 100.0)} AS low_primary,
  {ratio('b.refunds', 'b.gross_revenue', 100.0)} AS high_refund,
  {ratio('b.total_payroll_direct', 'b.revenue_accrual', 100.0)} AS payroll_overrun
FROM base b
LEFT JOIN base p1 ON p1.year_month + INTERVAL 1 MONTH = b.year_month AND p1.branch_id = b.branch_id
LEFT JOIN base p12 ON p12.year_month + INTERVAL 12 MONTH = b.year_month AND p12.branch_id = b.branch_id)"""
    parts = []
    for a_type, sev, metric, desc, advice in vocab.ALERT_TEMPLATES:
        th = float(Q.ALERT_THRESHOLDS[a_type])
        cmp = "<" if a_type == "low_primary" else ">"
        nd = 1 if ".1f" in desc else 0
        d = desc.replace("'", "''")
        parts.append(f"""SELECT year_month, branch_id, branch_name, '{a_type}' AS alert_type, '{sev}' AS severity,
  '{metric}' AS metric_name, ROUND({a_type}, 4) AS metric_value, CAST({th!r} AS DOUBLE) AS threshold_value,
  printf('{d}', ROUND({a_type}, {nd})) AS description, '{advice}' AS recommendation
FROM am WHERE {a_type} {cmp} {th!r}""")
    return S.with_pnl("base AS (SELECT * FROM pnl WHERE branch_id IS NOT NULL)", am,
                      "u AS (" + " UNION ALL ".join(parts) + ")",
                      """al AS (SELECT ROW_NUMBER() OVER (ORDER BY year_month, branch_id, alert_type) AS alert_id,
  CAST(year_month + INTERVAL 1 MONTH AS TIMESTAMP) AS created_at, year_month, branch_id, branch_name,
  CAST(NULL AS INTEGER) AS doctor_id, CAST(NULL AS VARCHAR) AS doctor_name, alert_type, severity, metric_name,
  metric_value, threshold_value, description, recommendation FROM u)""")


@query("alerts", _alerts_sql() + "SELECT * FROM al")
def alerts(spark, sf_dir):
    return finish(Q.alerts(_wh(spark, sf_dir).pnl))


@query("recent_alerts", _alerts_sql() + "SELECT * FROM al ORDER BY created_at DESC, alert_id DESC LIMIT 6")
def recent_alerts(spark, sf_dir):
    return finish(Q.recent_alerts(Q.alerts(_wh(spark, sf_dir).pnl), 6))


PROFILE_COLS = ["branch_id", "patient_hash", "payment_type_id", "service_name", "doctor_id", "is_primary_visit"]


@query("load_profile", S.with_fact() + "SELECT COUNT(*) AS rows, MIN(transaction_date) AS min_date, MAX(transaction_date) AS max_date, " +
       ", ".join(f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_{c}" for c in PROFILE_COLS) + " FROM fact")
def load_profile(spark, sf_dir):
    return finish(Q.load_profile(_wh(spark, sf_dir).fact, "transaction_date", PROFILE_COLS))


UNMAPPED = ["branch_id", "payment_type_id", "doctor_id", "service_name"]


@query("dq_unmapped", S.with_fact() + " UNION ALL ".join(
    f"SELECT '{c}' AS key_column, CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS unmapped FROM fact" for c in UNMAPPED))
def dq_unmapped(spark, sf_dir):
    from pyspark.sql import functions as F
    f = _wh(spark, sf_dir).fact
    row = f.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in UNMAPPED])
    stack = ", ".join(f"'{c}', `{c}`" for c in UNMAPPED)
    return row.selectExpr(f"stack({len(UNMAPPED)}, {stack}) as (key_column, unmapped)")


@query("dq_domain", S.with_fact() + """
SELECT operation_type AS value, COUNT(*) AS rows FROM fact
WHERE operation_type NOT IN ('payment', 'refund') OR operation_type IS NULL GROUP BY operation_type""")
def dq_domain(spark, sf_dir):
    return Q.dq_domain(_wh(spark, sf_dir).fact, "operation_type", [vocab.PAYMENT, vocab.REFUND])


@query("dq_orphans", S.with_fact(S.DIM_BRANCH, S.DIM_DOCTOR, S.DIM_SERVICE) + """
SELECT 'branch_id' AS foreign_key, COUNT(*) AS orphans FROM fact f
  WHERE f.branch_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_branch d WHERE d.branch_id = f.branch_id)
UNION ALL SELECT 'doctor_id', COUNT(*) FROM fact f
  WHERE f.doctor_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_doctor d WHERE d.doctor_id = f.doctor_id)
UNION ALL SELECT 'service_name', COUNT(*) FROM fact f
  WHERE f.service_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_service d WHERE d.name = f.service_name)""")
def dq_orphans(spark, sf_dir):
    w = _wh(spark, sf_dir)
    return Q.dq_orphans(w.fact, {"branch_id": (w.branches, "branch_id"), "doctor_id": (w.doctors, "doctor_id"),
                                 "service_name": (w.services, "name")})


@query("dq_duplicates", S.with_(S.COSTS, S.DIM_DOCTOR) + """
SELECT 'cost_rows' AS "table", service_name AS key, COUNT(*) AS rows FROM costs GROUP BY service_name HAVING COUNT(*) > 1
UNION ALL
SELECT 'dim_doctor', full_name, COUNT(*) FROM dim_doctor GROUP BY full_name HAVING COUNT(*) > 1""")
def dq_duplicates(spark, sf_dir):
    w = _wh(spark, sf_dir)
    return Q.dq_duplicates(w.costs, "service_name", "cost_rows").unionByName(
        Q.dq_duplicates(w.doctors, "full_name", "dim_doctor"))


# A feed with faults from the line items: dates that don't exist, codes that aren't known, doctors that no dimension has, no amount.
FAULTY_SQL = """feed AS (SELECT CASE WHEN l_linenumber = 7 THEN '31.02.1995' ELSE strftime(l_shipdate, '%d.%m.%Y') END AS date_text,
  CASE WHEN l_returnflag = 'N' AND l_linenumber = 6 THEN 'void' WHEN l_returnflag = 'R' THEN 'refund' ELSE 'payment' END AS operation_type,
  CASE WHEN l_linenumber = 5 THEN l_suppkey + 1000000 WHEN l_linenumber = 4 THEN NULL ELSE l_suppkey END AS doctor_id,
  CASE WHEN l_quantity = 50 THEN NULL ELSE l_extendedprice END AS amount FROM lineitem),
bad AS (SELECT TRY_STRPTIME(date_text, '%d.%m.%Y') IS NULL AS d, amount IS NULL AS a, operation_type NOT IN ('payment', 'refund') AS o,
  doctor_id IS NOT NULL AND doctor_id NOT IN (SELECT s_suppkey FROM supplier) AS k FROM feed)"""


@query("dq_one_pass", f"""WITH {FAULTY_SQL}
SELECT 'date' AS rule, COUNT(*) FILTER (WHERE d) AS rows FROM bad UNION ALL SELECT 'amount', COUNT(*) FILTER (WHERE a) FROM bad
UNION ALL SELECT 'operation', COUNT(*) FILTER (WHERE o) FROM bad UNION ALL SELECT 'doctor', COUNT(*) FILTER (WHERE k) FROM bad
UNION ALL SELECT 'quarantined', COUNT(*) FILTER (WHERE d OR a OR o OR k) FROM bad UNION ALL SELECT 'good', COUNT(*) FILTER (WHERE NOT (d OR a OR o OR k)) FROM bad""")
def dq_one_pass(spark, sf_dir):
    """Bad dates, amounts, codes and orphans found, counted and put aside in one scan of the feed."""
    from pyspark.sql import functions as F
    from ..sources.driver import read
    from ..streaming.incremental import scratch_dirs
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    feed = read(spark, sf_dir, "lineitem").select(
        F.when(line == 7, "31.02.1995").otherwise(F.date_format("l_shipdate", "dd.MM.yyyy")).alias("date_text"),
        F.when((flag == "N") & (line == 6), "void").when(flag == "R", vocab.REFUND).otherwise(vocab.PAYMENT).alias("operation_type"),
        F.when(line == 5, F.col("l_suppkey") + 1_000_000).when(line != 4, F.col("l_suppkey")).alias("doctor_id"),
        F.when(F.col("l_quantity") != 50, F.col("l_extendedprice")).alias("amount"))
    suppliers = read(spark, sf_dir, "supplier")
    found = Q.quarantine(feed, scratch_dirs(spark, "quarantine")[0],
                         {"date": F.try_to_timestamp("date_text", F.lit("dd.MM.yyyy")).isNull(), "amount": F.col("amount").isNull(),
                          "operation": ~F.col("operation_type").isin(vocab.PAYMENT, vocab.REFUND)},
                         {"doctor": ("doctor_id", suppliers, "s_suppkey")})
    return spark.createDataFrame(list(found.items()), "rule string, rows long")
