"""Report operators (AGG-7..28, WIN-*, TOP-*, FIL-*) as registered queries."""

from __future__ import annotations

import datetime as dt

from .. import vocab
from ..operators import reports as R
from ..operators import filters as FL
from ..sources.driver import Warehouse
from .registry import query, finish
from . import sqlbase as S
from .sqlbase import psum, fmean, ratio, r6

# Report parameters used by the registered queries.
PERIOD = (dt.date(1996, 1, 1), dt.date(2000, 12, 1))
BRANCHES = ["NATION_1", "NATION_3", "NATION_5", "NATION_7", "NATION_11", "NATION_19"]
SCOPED_BRANCH = 7
YEARS = (1998, 1999)


def _wh(spark, sf_dir):
    return Warehouse.of(spark, sf_dir)


def _pnl(spark, sf_dir):
    return _wh(spark, sf_dir).pnl


LO, HI = (f"DATE '{d.isoformat()}'" for d in PERIOD)
IN_BRANCHES = "(" + ", ".join(f"'{b}'" for b in BRANCHES) + ")"


@query("filter_period", S.with_pnl() + f"SELECT {S.pnl_select()} FROM pnl WHERE year_month BETWEEN {LO} AND {HI}")
def filter_period(spark, sf_dir):
    return finish(FL.filter_period(_pnl(spark, sf_dir), *PERIOD))


@query("filter_members", S.with_pnl() + f"SELECT {S.pnl_select()} FROM pnl WHERE branch_name IN {IN_BRANCHES}")
def filter_members(spark, sf_dir):
    return finish(FL.filter_members(_pnl(spark, sf_dir), branch_name=BRANCHES))


@query("branch_scoped_view", S.with_pnl() + f"SELECT {S.pnl_select()} FROM pnl WHERE branch_id = {SCOPED_BRANCH}")
def branch_scoped_view(spark, sf_dir):
    return finish(FL.branch_scoped_view(_pnl(spark, sf_dir), SCOPED_BRANCH))


@query("branch_view_sql", S.with_pnl() + f"SELECT {S.pnl_select()} FROM pnl WHERE branch_id = {SCOPED_BRANCH}")
def branch_view_sql(spark, sf_dir):
    """The scope in SQL: a stored mart, a view bound to the session's branch."""
    from ..operators import scoped
    from ..streaming.incremental import scratch_dirs
    path = scratch_dirs(spark, "scoped")[0]
    _pnl(spark, sf_dir).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("scoped_mart")
    scoped.register_scope(spark, "scoped_mart", "my_branch_pnl", "branch_pnl")
    scoped.set_scope(spark, SCOPED_BRANCH)
    return finish(spark.sql("SELECT * FROM my_branch_pnl"))


_TOT = ", ".join(f"{psum(m)} AS {m}" for m in R.PNL_METRICS)


@query("totals", S.with_pnl() + f"SELECT {_TOT} FROM pnl WHERE year_month BETWEEN {LO} AND {HI} AND branch_name IN {IN_BRANCHES}")
def totals(spark, sf_dir):
    p = FL.filter_members(FL.filter_period(_pnl(spark, sf_dir), *PERIOD), branch_name=BRANCHES)
    return finish(R.totals(p))


_MT = ", ".join(f"COALESCE(SUM({m}), 0) AS {m}" for m in R.PNL_METRICS)
MONTHLY_TOTAL = f"mt AS (SELECT year_month, {_MT} FROM pnl GROUP BY year_month)"


@query("monthly_total", S.with_pnl(MONTHLY_TOTAL) + "SELECT year_month, " +
       ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in R.PNL_METRICS) +
       f", {ratio('ebitda', 'revenue_accrual', 100.0)} AS ebitda_margin, "
       f"{ratio('gross_margin', 'revenue_accrual', 100.0)} AS gross_margin_pct FROM mt")
def monthly_total(spark, sf_dir):
    return finish(R.monthly_total(_pnl(spark, sf_dir)))


@query("branch_summary", S.with_pnl(f"""bs AS (
  SELECT branch_name, COALESCE(SUM(revenue_accrual), 0) AS revenue_accrual, COALESCE(SUM(ebitda), 0) AS ebitda,
         {fmean('avg_ticket')} AS avg_ticket, {psum('unique_patients', True)} AS unique_patients,
         {psum('primary_visits', True)} AS primary_visits, COALESCE(SUM(materials), 0) AS materials,
         COALESCE(SUM(total_payroll_direct), 0) AS total_payroll_direct,
         COALESCE(SUM(gross_revenue), 0) AS g, COALESCE(SUM(payment_count), 0) AS n
  FROM pnl WHERE year_month BETWEEN {LO} AND {HI} GROUP BY branch_name)""",
                                  f"""dp AS (SELECT b.display_name AS branch_name, COUNT(DISTINCT f.patient_hash) AS distinct_patients
  FROM fact f JOIN dim_branch b ON f.branch_id = b.branch_id
  WHERE f.year_month BETWEEN {LO} AND {HI} GROUP BY b.display_name)""") + f"""
SELECT bs.branch_name, CAST(revenue_accrual AS DOUBLE) AS revenue_accrual, CAST(ebitda AS DOUBLE) AS ebitda, avg_ticket,
       unique_patients, primary_visits, CAST(materials AS DOUBLE) AS materials,
       CAST(total_payroll_direct AS DOUBLE) AS total_payroll_direct,
       {r6(ratio('ebitda', 'revenue_accrual'))} AS ebitda_margin,
       {r6(ratio('materials + total_payroll_direct', 'revenue_accrual'))} AS cost_ratio,
       {r6(ratio('primary_visits', 'unique_patients'))} AS primary_share,
       {r6(ratio('g', 'n'))} AS weighted_ticket, dp.distinct_patients
FROM bs LEFT JOIN dp ON bs.branch_name = dp.branch_name""")
def branch_summary(spark, sf_dir):
    w = _wh(spark, sf_dir)
    return finish(R.branch_summary(FL.filter_period(w.pnl, *PERIOD), FL.filter_period(w.fact, *PERIOD)))


@query("branch_month_series", S.with_pnl() + "SELECT year_month, branch_id, branch_name, CAST(revenue_accrual AS DOUBLE) AS revenue_accrual FROM pnl")
def branch_month_series(spark, sf_dir):
    return finish(R.branch_month_series(_pnl(spark, sf_dir)))


@query("ebitda_margin_branch", S.with_pnl() + f"""
SELECT branch_name, {psum('revenue_accrual')} AS revenue_accrual, {psum('ebitda')} AS ebitda,
       {r6(ratio('COALESCE(SUM(ebitda), 0)', 'COALESCE(SUM(revenue_accrual), 0)', 100.0))} AS ebitda_margin
FROM pnl WHERE year_month BETWEEN {LO} AND {HI} GROUP BY branch_name""")
def ebitda_margin_branch(spark, sf_dir):
    return finish(R.ebitda_margin_branch(FL.filter_period(_pnl(spark, sf_dir), *PERIOD)))


@query("revenue_share", S.with_pnl("rs AS (SELECT branch_name, COALESCE(SUM(revenue_accrual), 0) AS revenue_accrual FROM pnl GROUP BY branch_name)") + f"""
SELECT branch_name, CAST(revenue_accrual AS DOUBLE) AS revenue_accrual,
       {r6(ratio('revenue_accrual', 'SUM(revenue_accrual) OVER ()'))} AS share FROM rs""")
def revenue_share(spark, sf_dir):
    return finish(R.revenue_share(_pnl(spark, sf_dir)))


@query("child_adult", S.with_bc() + f"""
SELECT branch_name, {psum('children_revenue')} AS children_revenue, {psum('adult_revenue')} AS adult_revenue
FROM branch_comparison GROUP BY branch_name""")
def child_adult(spark, sf_dir):
    return finish(R.child_adult(_wh(spark, sf_dir).branch_comparison))


BRANCH_AGG = f"""ba AS (
  SELECT branch_name, COALESCE(SUM(revenue_accrual), 0) AS revenue_accrual, COALESCE(SUM(ebitda), 0) AS ebitda,
         {psum('unique_patients', True)} AS unique_patients, {fmean('avg_ticket')} AS avg_ticket,
         {psum('primary_visits', True)} AS primary_visits
  FROM pnl GROUP BY branch_name)"""


@query("branch_ranking", S.with_pnl(BRANCH_AGG) + f"""
SELECT ROW_NUMBER() OVER (ORDER BY revenue_accrual DESC, branch_name ASC) AS rank, branch_name,
       CAST(revenue_accrual AS DOUBLE) AS revenue_accrual, CAST(ebitda AS DOUBLE) AS ebitda,
       {r6(ratio('ebitda', 'revenue_accrual', 100.0))} AS ebitda_margin, unique_patients, avg_ticket, primary_visits
FROM ba""")
def branch_ranking(spark, sf_dir):
    return finish(R.branch_ranking(_pnl(spark, sf_dir)))


def _radar(m):
    mx = f"MAX({m}) OVER ()"
    return (f"ROUND(CASE WHEN {mx} > 0 THEN CAST({m} AS DOUBLE) / CAST({mx} AS DOUBLE) * 100.0 "
            f"ELSE CAST({m} AS DOUBLE) END, 6) AS {m}")


@query("branch_radar", S.with_pnl(BRANCH_AGG) + "SELECT branch_name, " +
       ", ".join(_radar(m) for m in R.RADAR_METRICS) + " FROM ba")
def branch_radar(spark, sf_dir):
    return finish(R.branch_radar(_pnl(spark, sf_dir)))


def _mom(c):
    return (f"m.{c}, p.{c} AS {c}_prev, "
            f"{r6(f'({ratio(f'm.{c}', f'p.{c}')} - 1.0) * 100.0')} AS {c}_change_pct")


@query("kpi_mom", S.with_pnl(f"""m AS (
  SELECT year_month, CAST(COALESCE(SUM(revenue_accrual), 0) AS DOUBLE) AS revenue,
         CAST(COALESCE(SUM(ebitda), 0) AS DOUBLE) AS ebitda, {fmean('avg_ticket')} AS avg_ticket,
         {psum('unique_patients', True)} AS patients
  FROM pnl GROUP BY year_month)""") + "SELECT m.year_month, " +
       ", ".join(_mom(c) for c in ("revenue", "ebitda", "avg_ticket", "patients")) +
       " FROM m LEFT JOIN m p ON p.year_month + INTERVAL 1 MONTH = m.year_month")
def kpi_mom(spark, sf_dir):
    return finish(R.kpi_mom(_pnl(spark, sf_dir)))


@query("cumulative_balance", S.with_cf("""mb AS (
  SELECT year_month, SUM(CASE WHEN direction = 'inflow' THEN amount ELSE -amount END) AS net FROM cfl GROUP BY year_month)""") +
       """SELECT year_month, CAST(net AS DOUBLE) AS net,
       CAST(SUM(net) OVER (ORDER BY year_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS balance FROM mb""")
def cumulative_balance(spark, sf_dir):
    return finish(R.cumulative_balance(_wh(spark, sf_dir).cf_lines))


@query("ticket_series", S.with_pnl() + """
SELECT branch_id, branch_name, year_month, avg_ticket,
       MAX(avg_ticket) OVER (PARTITION BY branch_id ORDER BY 12 * year(year_month) + month(year_month) RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev_ticket,
       ROUND(AVG(avg_ticket) OVER (PARTITION BY branch_id ORDER BY 12 * year(year_month) + month(year_month) RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ticket_ma
FROM pnl""")
def ticket_series(spark, sf_dir):
    return finish(R.ticket_series(_pnl(spark, sf_dir)))


CF_FILTER = f"year_month BETWEEN {LO} AND {HI} AND branch_name IN {IN_BRANCHES}"


def _cf(spark, sf_dir):
    return FL.filter_members(FL.filter_period(_wh(spark, sf_dir).cf_lines, *PERIOD), branch_name=BRANCHES)


KPI_SQL = f"""k AS (
  SELECT COALESCE(SUM(amount) FILTER (WHERE direction = 'inflow'), 0) AS inflow,
         COALESCE(SUM(amount) FILTER (WHERE direction = 'outflow'), 0) AS outflow
  FROM cfl WHERE {CF_FILTER})"""


@query("cashflow_kpis", S.with_cf(KPI_SQL) + f"""
SELECT CAST(inflow AS DOUBLE) AS inflow, CAST(outflow AS DOUBLE) AS outflow, CAST(inflow - outflow AS DOUBLE) AS net,
       {r6(ratio('inflow - outflow', 'inflow', 100.0))} AS net_pct FROM k""")
def cashflow_kpis(spark, sf_dir):
    return finish(R.cashflow_kpis(_cf(spark, sf_dir)))


@query("cashflow_statement", S.with_cf(f"""g AS (
  SELECT cf_group, line_item, direction, GROUPING(cf_group, line_item, direction) AS gid,
         SUM(amount) FILTER (WHERE direction = 'inflow') AS inflow,
         SUM(amount) FILTER (WHERE direction = 'outflow') AS outflow
  FROM cfl WHERE {CF_FILTER}
  GROUP BY GROUPING SETS ((cf_group, line_item, direction), (cf_group)))""") + """
SELECT cf_group, line_item, direction, CASE WHEN gid = 0 THEN 'item' ELSE 'group' END AS level,
       CAST(inflow AS DOUBLE) AS inflow, CAST(outflow AS DOUBLE) AS outflow,
       CAST(COALESCE(inflow, 0) - COALESCE(outflow, 0) AS DOUBLE) AS net FROM g""")
def cashflow_statement(spark, sf_dir):
    return finish(R.cashflow_statement(_cf(spark, sf_dir)))


@query("cashflow_bridge", S.with_cf(KPI_SQL, f"""t AS (
  SELECT line_item, direction, SUM(amount) AS total FROM cfl WHERE {CF_FILTER} GROUP BY line_item, direction),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY direction ORDER BY total DESC, line_item) AS rk FROM t),
steps AS (
  SELECT CASE WHEN direction = 'inflow' THEN rk ELSE rk + 3 END AS ordinal, line_item AS label,
         CASE WHEN direction = 'inflow' THEN 'absolute' ELSE 'relative' END AS role,
         CASE WHEN direction = 'inflow' THEN total ELSE -total END AS value
  FROM r WHERE (direction = 'inflow' AND rk <= 3) OR (direction = 'outflow' AND rk <= 8)
  UNION ALL SELECT 12, 'net', 'total', inflow - outflow FROM k)""") + """
SELECT ordinal, label, role, CAST(value AS DOUBLE) AS value,
       CAST(CASE WHEN role = 'total' THEN value ELSE SUM(CASE WHEN role <> 'total' THEN value ELSE 0 END)
            OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS DOUBLE) AS level
FROM steps""")
def cashflow_bridge(spark, sf_dir):
    return finish(R.cashflow_bridge(_cf(spark, sf_dir)))


TOP_EXP = f"""te AS (SELECT line_item, SUM(amount) AS amount FROM cfl WHERE direction = 'outflow' AND {CF_FILTER}
  GROUP BY line_item ORDER BY amount DESC, line_item LIMIT {{n}})"""


@query("top_expenses", S.with_cf(TOP_EXP.format(n=8)) + "SELECT line_item, CAST(amount AS DOUBLE) AS amount FROM te")
def top_expenses(spark, sf_dir):
    return finish(R.top_expenses(_cf(spark, sf_dir), 8))


@query("top_items_by_month", S.with_cf(TOP_EXP.format(n=6)) + f"""
SELECT year_month, line_item, CAST(SUM(amount) AS DOUBLE) AS total FROM cfl
WHERE direction = 'outflow' AND {CF_FILTER} AND line_item IN (SELECT line_item FROM te)
GROUP BY year_month, line_item""")
def top_items_by_month(spark, sf_dir):
    return finish(R.top_items_by_month(_cf(spark, sf_dir), 6))


def _stmt_sql(last_n=6):
    lines = vocab.PNL_LINES
    vals = " UNION ALL ".join(
        f"SELECT {o} AS line_no, '{lbl}' AS line, slot, {m} AS value FROM rk" for o, lbl, m in lines)
    tots = " UNION ALL ".join(
        f"SELECT {o} AS line_no, COALESCE(SUM({m}), 0) AS total FROM pnl" for o, _, m in lines)
    slots = ", ".join(f"CAST(MAX(value) FILTER (WHERE slot = {i}) AS DOUBLE) AS m{i}" for i in range(1, last_n + 1))
    return S.with_pnl(MONTHLY_TOTAL, f"""rk0 AS (SELECT *, ROW_NUMBER() OVER (ORDER BY year_month DESC) AS r FROM mt),
rk AS (SELECT *, MAX(r) FILTER (WHERE r <= {last_n}) OVER () - r + 1 AS slot FROM rk0 WHERE r <= {last_n}),
v AS ({vals}),
w AS (SELECT line_no, line, {slots} FROM v GROUP BY line_no, line),
tt AS ({tots})""") + "SELECT w.*, CAST(tt.total AS DOUBLE) AS total FROM w LEFT JOIN tt USING (line_no)"


@query("pnl_statement", _stmt_sql())
def pnl_statement(spark, sf_dir):
    return finish(R.pnl_statement(_pnl(spark, sf_dir)))


def _bridge_sql():
    steps = vocab.EBITDA_BRIDGE
    metrics = list(dict.fromkeys(m for _, _, m, _, _ in steps))
    tot = ", ".join(f"COALESCE(SUM({m}), 0) AS {m}" for m in metrics)
    rows = " UNION ALL ".join(f"SELECT {o} AS ordinal, '{lbl}' AS step, '{role}' AS role, {s} * {m} AS value FROM t"
                              for o, lbl, m, s, role in steps)
    return S.with_pnl(f"t AS (SELECT {tot} FROM pnl WHERE year_month BETWEEN {LO} AND {HI})", f"s AS ({rows})") + """
SELECT ordinal, step, role, CAST(value AS DOUBLE) AS value,
       CAST(CASE WHEN role = 'total' THEN value ELSE SUM(CASE WHEN role <> 'total' THEN value ELSE 0 END)
            OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS DOUBLE) AS level FROM s"""


@query("ebitda_bridge", _bridge_sql())
def ebitda_bridge(spark, sf_dir):
    return finish(R.ebitda_bridge(FL.filter_period(_pnl(spark, sf_dir), *PERIOD)))


def _yoy_sql():
    y0, y1 = YEARS
    aggs = []
    rows = []
    for o, lbl, m, how in vocab.YOY_METRICS:
        for tag, y in (("base", y0), ("cur", y1)):
            v = f"CASE WHEN year(year_month) = {y} THEN {m} END"
            aggs.append(f"{fmean(v) if how == 'mean' else psum(v)} AS {m}__{tag}")
        rows.append(f"SELECT {o} AS ordinal, '{lbl}' AS label, '{m}' AS metric, {m}__base AS value_base, "
                    f"{m}__cur AS value_cur FROM g")
    lo, hi = dt.date(min(YEARS), 1, 1), dt.date(max(YEARS), 12, 31)
    return S.with_pnl(f"g AS (SELECT {', '.join(aggs)} FROM pnl WHERE year_month BETWEEN DATE '{lo}' AND DATE '{hi}')",
                      f"l AS ({' UNION ALL '.join(rows)})") + f"""
SELECT ordinal, label, metric, value_base, value_cur,
       ROUND(CASE WHEN value_base = 0 THEN 0.0 ELSE (value_cur / value_base - 1.0) * 100.0 END, 6) AS delta_pct,
       {y0} AS year_base, {y1} AS year_cur FROM l"""


@query("yoy", _yoy_sql())
def yoy(spark, sf_dir):
    return finish(R.yoy(_pnl(spark, sf_dir), *YEARS))


DOC_SUMMARY = f"""ds AS (
  SELECT doctor_name, specialization, branch_name, COALESCE(SUM(revenue), 0) AS revenue,
         {psum('visit_count', True)} AS visit_count, {psum('unique_patients', True)} AS unique_patients,
         {psum('primary_visits', True)} AS primary_visits, {fmean('avg_ticket')} AS avg_ticket,
         {fmean('revenue_per_workday')} AS revenue_per_workday
  FROM doctor_kpi GROUP BY doctor_name, specialization, branch_name)"""


@query("doctor_summary", S.with_dk(DOC_SUMMARY) + "SELECT * REPLACE (CAST(revenue AS DOUBLE) AS revenue) FROM ds")
def doctor_summary(spark, sf_dir):
    return finish(R.doctor_summary(_wh(spark, sf_dir).doctor_kpi))


@query("top_doctors", S.with_dk(DOC_SUMMARY) +
       "SELECT * REPLACE (CAST(revenue AS DOUBLE) AS revenue) FROM ds ORDER BY revenue DESC, doctor_name, branch_name LIMIT 15")
def top_doctors(spark, sf_dir):
    return finish(R.top_doctors(_wh(spark, sf_dir).doctor_kpi, 15))


@query("spec_summary", S.with_dk() + f"""
SELECT specialization, {fmean('avg_ticket')} AS avg_ticket, {psum('revenue')} AS revenue FROM doctor_kpi GROUP BY specialization""")
def spec_summary(spark, sf_dir):
    return finish(R.spec_summary(_wh(spark, sf_dir).doctor_kpi))


# The months of the driver's ship dates, given on both sides so that the schema doesn't follow the data.
HEATMAP_MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2001 + 1) for m in range(1, 13)]


@query("doctor_heatmap", S.with_dk(DOC_SUMMARY, """top AS (SELECT doctor_name FROM ds ORDER BY revenue DESC, doctor_name, branch_name LIMIT 15),
h AS (SELECT doctor_name, strftime(year_month, '%Y-%m') AS month, revenue FROM doctor_kpi
      WHERE doctor_name IN (SELECT doctor_name FROM top))""") +
       "SELECT doctor_name, " + ", ".join(f"CAST(COALESCE(SUM(revenue) FILTER (WHERE month = '{m}'), 0) AS DOUBLE) AS \"{m}\"" for m in HEATMAP_MONTHS) +
       " FROM h GROUP BY doctor_name")
def doctor_heatmap(spark, sf_dir):
    return finish(R.doctor_heatmap(_wh(spark, sf_dir).doctor_kpi, 15, HEATMAP_MONTHS))


SVC_SUMMARY = f"""ss AS (
  SELECT service_name, category, {psum('total_revenue')} AS total_revenue, {psum('service_count', True)} AS service_count,
         ROUND(AVG(margin_pct) * 100.0, 6) AS margin_pct, {fmean('avg_price')} AS avg_price
  FROM service_economics GROUP BY service_name, category)"""


@query("service_summary", S.with_se(SVC_SUMMARY) + "SELECT * FROM ss")
def service_summary(spark, sf_dir):
    return finish(R.service_summary(_wh(spark, sf_dir).service_economics))


@query("service_kpis", S.with_se() + f"""
SELECT {psum('total_revenue')} AS total_revenue, ROUND(AVG(margin_pct) * 100.0, 6) AS avg_margin_pct,
       {psum('service_count', True)} AS total_services, COUNT(DISTINCT service_name) AS unique_services
FROM service_economics""")
def service_kpis(spark, sf_dir):
    return finish(R.service_kpis(_wh(spark, sf_dir).service_economics))


@query("revenue_tree", S.with_se("""g AS (
  SELECT category, service_name, SUM(total_revenue) AS total_revenue, GROUPING(category, service_name) AS gid
  FROM service_economics GROUP BY ROLLUP (category, service_name))""") + f"""
SELECT category, service_name, CASE WHEN gid = 3 THEN 'root' WHEN gid = 1 THEN 'category' ELSE 'service' END AS level,
       CAST(total_revenue AS DOUBLE) AS total_revenue,
       {r6(ratio('total_revenue', 'MAX(CASE WHEN gid = 3 THEN total_revenue END) OVER ()'))} AS share_of_root FROM g""")
def revenue_tree(spark, sf_dir):
    return finish(R.revenue_tree(_wh(spark, sf_dir).service_economics))


@query("category_branch", S.with_se() + f"""
SELECT category, branch_name, {psum('total_revenue')} AS total_revenue FROM service_economics GROUP BY category, branch_name""")
def category_branch(spark, sf_dir):
    return finish(R.category_branch(_wh(spark, sf_dir).service_economics))


@query("top_services_revenue", S.with_se(SVC_SUMMARY) +
       "SELECT * FROM ss ORDER BY total_revenue DESC NULLS LAST, service_name LIMIT 10")
def top_services_revenue(spark, sf_dir):
    return finish(R.top_services(_wh(spark, sf_dir).service_economics, "total_revenue", 10))


@query("top_services_margin", S.with_se(SVC_SUMMARY) +
       "SELECT * FROM ss ORDER BY margin_pct DESC NULLS LAST, service_name LIMIT 10")
def top_services_margin(spark, sf_dir):
    return finish(R.top_services(_wh(spark, sf_dir).service_economics, "margin_pct", 10))
