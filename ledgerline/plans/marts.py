"""Marts (AGG-1..6) as registered queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import marts as M
from ..sources.driver import Warehouse, DRIVER_CF_PATTERNS
from .registry import query, finish
from . import sqlbase as S


def _wh(spark, sf_dir):
    return Warehouse.of(spark, sf_dir)


@query("monthly_pnl", S.with_pnl() + f"SELECT {S.pnl_select()} FROM pnl")
def monthly_pnl(spark, sf_dir):
    return finish(_wh(spark, sf_dir).pnl)


@query("revenue_accrual", S.with_fact(S.REVENUE_ACCRUAL) + """
SELECT year_month, branch_id, CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(refunds AS DOUBLE) AS refunds,
       CAST(net_revenue AS DOUBLE) AS net_revenue, unique_patients, payment_count, primary_visits, avg_ticket
FROM revenue_accrual""")
def revenue_accrual(spark, sf_dir):
    return finish(M.revenue_accrual(_wh(spark, sf_dir).fact))


@query("cf_summary", S.with_(S.OA, S.CF, S.CF_SUMMARY) + "SELECT year_month, branch_id, " +
       ", ".join(f"CAST({b} AS DOUBLE) AS {b}" for b in DRIVER_CF_PATTERNS) + " FROM cf_summary")
def cf_summary(spark, sf_dir):
    return finish(M.cf_summary(_wh(spark, sf_dir).cf, DRIVER_CF_PATTERNS))


@query("doctor_kpi", S.with_dk() + """
SELECT year_month, doctor_id, doctor_name, specialization, branch_id, branch_name,
       CAST(revenue AS DOUBLE) AS revenue, visit_count, unique_patients, primary_visits, avg_ticket,
       revenue_per_workday
FROM doctor_kpi""")
def doctor_kpi(spark, sf_dir):
    return finish(_wh(spark, sf_dir).doctor_kpi)


@query("branch_comparison", S.with_bc() + """
SELECT year_month, branch_id, branch_name, CAST(revenue AS DOUBLE) AS revenue, CAST(net_revenue AS DOUBLE) AS net_revenue,
       payments, unique_patients, primary_visits, avg_ticket,
       CAST(children_revenue AS DOUBLE) AS children_revenue, CAST(adult_revenue AS DOUBLE) AS adult_revenue
FROM branch_comparison""")
def branch_comparison(spark, sf_dir):
    return finish(_wh(spark, sf_dir).branch_comparison)


@query("service_economics", S.with_se() + """
SELECT service_name, branch_id, branch_name, service_count, CAST(total_revenue AS DOUBLE) AS total_revenue,
       avg_price, CAST(material_cost AS DOUBLE) AS material_cost, CAST(doctor_pay AS DOUBLE) AS doctor_pay,
       margin_pct, category
FROM service_economics""")
def service_economics(spark, sf_dir):
    return finish(_wh(spark, sf_dir).service_economics)


# Costs that change over time: a name's types take effect one after the other, a good year apart.
DATED_COSTS = """dated AS (SELECT *, CAST(DATE '1992-06-01' + CAST(400 * (row_number() OVER (PARTITION BY service_name ORDER BY service_code) - 1) AS INTEGER) AS DATE) AS effective_date FROM costs)"""


@query("service_economics_asof", S.with_fact(S.COSTS, DATED_COSTS, S.DIM_BRANCH, S.DIM_SERVICE) + """
SELECT x.service_name, x.branch_id, b.display_name AS branch_name, x.service_count, CAST(x.total_revenue AS DOUBLE) AS total_revenue,
       CAST(x.total_revenue AS DOUBLE) / x.service_count AS avg_price, CAST(x.material_cost AS DOUBLE) AS material_cost,
       CAST(x.doctor_pay AS DOUBLE) AS doctor_pay, x.margin_pct, s.category
FROM (SELECT f.service_name, f.branch_id, c.material_cost, c.doctor_pay, c.margin_pct,
    COUNT(*) FILTER (WHERE f.operation_type = 'payment') AS service_count, SUM(f.transaction_amount) FILTER (WHERE f.operation_type = 'payment') AS total_revenue
  FROM fact f ASOF LEFT JOIN dated c ON f.service_name = c.service_name AND f.transaction_date >= c.effective_date
  WHERE f.service_name IS NOT NULL GROUP BY ALL) x
LEFT JOIN dim_branch b ON x.branch_id = b.branch_id LEFT JOIN dim_service s ON x.service_name = s.name
WHERE x.service_count >= 5""")
def service_economics_asof(spark, sf_dir):
    w = _wh(spark, sf_dir)
    turn = F.row_number().over(Window.partitionBy("service_name").orderBy("service_code")) - 1
    dated = w.costs.withColumn("effective_date", F.date_add(F.lit("1992-06-01").cast("date"), turn * 400))
    return finish(M.service_economics_asof(w.fact, dated, w.branches, w.services))
