"""Planning operators (PLN-*) and SET-3 as registered queries."""

from __future__ import annotations

from .. import vocab
from ..operators import planning as P
from ..sources.driver import Warehouse
from .registry import query, finish
from . import sqlbase as S

HORIZON, GROWTH, UP, DOWN = 6, 12.0, 10.0, -10.0
GAP_YEAR = 1999


def _pnl(spark, sf_dir):
    return Warehouse.of(spark, sf_dir).pnl


def _d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


MS = """m AS (SELECT year_month, COALESCE(SUM(revenue_accrual), 0) AS revenue, COALESCE(SUM(ebitda), 0) AS ebitda
  FROM pnl GROUP BY year_month)"""


def _forecast_ctes():
    season = "CASE " + " ".join(f"WHEN month(ym) = {k} THEN {_d(float(v))}" for k, v in vocab.SEASONALITY.items()) + " END"
    gf = "[" + ", ".join(_d(x) for x in P.growth_factors(GROWTH, HORIZON)) + "]"
    up, dn = 1 + UP / 100, 1 + DOWN / 100
    return [MS, """l AS (SELECT * FROM m ORDER BY year_month DESC LIMIT 12)""",
            """b AS (SELECT max(year_month) AS last_month, CAST(SUM(revenue) AS DOUBLE) / CAST(COUNT(revenue) AS DOUBLE) AS avg_rev,
                     CAST(SUM(ebitda) AS DOUBLE) / CAST(COUNT(ebitda) AS DOUBLE) AS avg_ebitda FROM l)""",
            f"""s AS (SELECT b.*, step, CAST(last_month + to_months(step) AS DATE) AS ym
                      FROM b, (SELECT unnest(generate_series(1, {HORIZON})) AS step) t)""",
            f"""f0 AS (SELECT ym AS year_month, step, avg_rev * ({season}) * ({gf})[step] AS revenue_base,
                       CASE WHEN avg_rev <> 0 AND avg_rev IS NOT NULL THEN avg_ebitda / avg_rev ELSE {_d(0.15)} END AS er FROM s)""",
            f"""fc AS (SELECT year_month, step, revenue_base, revenue_base * {_d(up)} AS revenue_optimistic,
                       revenue_base * {_d(dn)} AS revenue_pessimistic, revenue_base * er AS ebitda_base,
                       revenue_base * {_d(up)} * er AS ebitda_optimistic, revenue_base * {_d(dn)} * er AS ebitda_pessimistic,
                       ROUND(er * 100.0, 6) AS ebitda_margin FROM f0)"""]


@query("forecast", S.with_pnl(*_forecast_ctes()) + "SELECT * FROM fc")
def forecast(spark, sf_dir):
    return finish(P.forecast(_pnl(spark, sf_dir), HORIZON, GROWTH, UP, DOWN))


@query("forecast_kpis", S.with_pnl(*_forecast_ctes()) + f"""
SELECT ROUND(SUM(revenue_base), 2) AS fc_revenue, ROUND(SUM(ebitda_base), 2) AS fc_ebitda,
       ROUND(SUM(revenue_base) / {_d(float(HORIZON))} * 12.0, 2) AS annual_forecast,
       ROUND(SUM(ebitda_base) / NULLIF(SUM(revenue_base), 0) * 100.0, 6) AS fc_margin_pct,
       (SELECT CAST(SUM(revenue) AS DOUBLE) FROM m) AS hist_revenue
FROM fc""")
def forecast_kpis(spark, sf_dir):
    return finish(P.forecast_kpis(_pnl(spark, sf_dir), HORIZON, growth_pct=GROWTH, optimistic_pct=UP,
                                  pessimistic_pct=DOWN))


@query("fact_plus_forecast", S.with_pnl(*_forecast_ctes()) + """
SELECT year_month, 'actual' AS kind, CAST(revenue AS DOUBLE) AS revenue, CAST(ebitda AS DOUBLE) AS ebitda,
       CAST(NULL AS DOUBLE) AS revenue_optimistic, CAST(NULL AS DOUBLE) AS revenue_pessimistic FROM m
UNION ALL
SELECT year_month, 'forecast', revenue_base, ebitda_base, revenue_optimistic, revenue_pessimistic FROM fc""")
def fact_plus_forecast(spark, sf_dir):
    return finish(P.fact_plus_forecast(_pnl(spark, sf_dir), HORIZON, growth_pct=GROWTH, optimistic_pct=UP,
                                       pessimistic_pct=DOWN))


def _gap_sql():
    y1, y0 = GAP_YEAR, GAP_YEAR - 1
    k = _d(1 + GROWTH / 100)
    return S.with_pnl(f"""g AS (SELECT branch_name,
    COALESCE(SUM(revenue_accrual) FILTER (WHERE year(year_month) = {y1}), 0) AS rf,
    COALESCE(SUM(ebitda) FILTER (WHERE year(year_month) = {y1}), 0) AS ef,
    COALESCE(SUM(revenue_accrual) FILTER (WHERE year(year_month) = {y0}), 0) AS r0,
    COALESCE(SUM(ebitda) FILTER (WHERE year(year_month) = {y0}), 0) AS e0,
    COUNT(*) FILTER (WHERE year(year_month) = {y1}) AS n1, COUNT(*) FILTER (WHERE year(year_month) = {y0}) AS n0,
    CAST(MAX(month(year_month)) FILTER (WHERE year(year_month) = {y1}) AS INTEGER) AS mmax
  FROM pnl WHERE year_month BETWEEN DATE '{y0}-01-01' AND DATE '{y1}-12-31' GROUP BY branch_name)""",
                      "g2 AS (SELECT *, MAX(mmax) OVER () AS months_passed FROM g)",
                      f"""g3 AS (SELECT branch_name, months_passed, CAST(rf AS DOUBLE) AS revenue_fact,
        CAST(r0 AS DOUBLE) * {k} * months_passed / 12 AS revenue_plan_ytd, CAST(ef AS DOUBLE) AS ebitda_fact,
        CAST(e0 AS DOUBLE) * {k} * months_passed / 12 AS ebitda_plan_ytd FROM g2 WHERE n1 > 0 AND n0 > 0)""") + f"""
SELECT *, revenue_fact - revenue_plan_ytd AS revenue_gap, ebitda_fact - ebitda_plan_ytd AS ebitda_gap,
       {S.r6(S.ratio('revenue_fact - revenue_plan_ytd', 'revenue_plan_ytd', 100.0))} AS revenue_gap_pct,
       {S.r6(S.ratio('ebitda_fact - ebitda_plan_ytd', 'ebitda_plan_ytd', 100.0))} AS ebitda_gap_pct FROM g3"""


@query("gap_analysis", _gap_sql())
def gap_analysis(spark, sf_dir):
    return finish(P.gap_analysis(_pnl(spark, sf_dir), GAP_YEAR, GROWTH))


def _mean(c):
    return f"CAST(SUM({c}) AS DOUBLE) / NULLIF(CAST(COUNT({c}) AS DOUBLE), 0) AS {c}"


_BE_COLS = ["revenue_accrual", "materials", "lab", "payroll_doctors", "payroll_assistants", "rent", "marketing", "it_costs"]


@query("breakeven", S.with_pnl(
    f"g AS (SELECT branch_name, {', '.join(_mean(c) for c in _BE_COLS)}, AVG(avg_ticket) AS t FROM pnl GROUP BY branch_name)",
    """g1 AS (SELECT branch_name, revenue_accrual, t, rent + it_costs AS fixed_costs,
             materials + lab + payroll_doctors + payroll_assistants + marketing AS variable_costs FROM g)""",
    "g2 AS (SELECT *, variable_costs / NULLIF(revenue_accrual, 0) AS variable_pct FROM g1)",
    "g3 AS (SELECT *, 1.0 - variable_pct AS contribution_margin FROM g2)",
    "g4 AS (SELECT *, fixed_costs / NULLIF(contribution_margin, 0) AS breakeven_revenue FROM g3)",
    """g5 AS (SELECT *, round_even(breakeven_revenue / NULLIF(t, 0), 0) AS breakeven_patients,
             (revenue_accrual - breakeven_revenue) / NULLIF(revenue_accrual, 0) * 100.0 AS safety_margin FROM g4)""") + """
SELECT branch_name, ROUND(revenue_accrual, 6) AS avg_revenue, ROUND(fixed_costs, 6) AS fixed_costs,
       ROUND(variable_costs, 6) AS variable_costs, ROUND(variable_pct, 6) AS variable_pct,
       ROUND(contribution_margin, 6) AS contribution_margin, ROUND(breakeven_revenue, 6) AS breakeven_revenue,
       breakeven_patients, ROUND(safety_margin, 6) AS safety_margin,
       CASE WHEN safety_margin < 20.0 THEN 'red' WHEN safety_margin < 40.0 THEN 'amber'
            WHEN safety_margin IS NOT NULL THEN 'green' END AS safety_band
FROM g5""")
def breakeven(spark, sf_dir):
    return finish(P.breakeven(_pnl(spark, sf_dir)))


@query("seasonality_index", S.with_pnl(MS, "sm AS (SELECT CAST(month(year_month) AS INTEGER) AS month_num, SUM(revenue) AS s, COUNT(revenue) AS n FROM m GROUP BY 1)") + """
SELECT month_num, n AS n_months,
       ROUND((CAST(s AS DOUBLE) / CAST(n AS DOUBLE)) / (CAST(SUM(s) OVER () AS DOUBLE) / CAST(SUM(n) OVER () AS DOUBLE)), 6) AS fitted_factor,
       """ + "CASE " + " ".join(f"WHEN month_num = {k} THEN {_d(float(v))}" for k, v in vocab.SEASONALITY.items()) +
       " END AS configured_factor FROM sm")
def seasonality_index(spark, sf_dir):
    return finish(P.seasonality_index(_pnl(spark, sf_dir)))
