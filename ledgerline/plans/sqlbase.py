"""DuckDB CTEs mirroring the star-schema adapter (``sources/driver.py``).

Used only by the oracle side of the correctness gate.
"""

from __future__ import annotations

from ..sources.driver import DRIVER_CF_PATTERNS, DRIVER_SERVICE_RULES, DRIVER_SERVICE_DEFAULT
from .. import vocab

OA = """oa AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderpriority, o.o_totalprice, o.o_orderdate, o.o_orderstatus,
         substr(sha256(c.c_name), 1, 16) AS patient_hash,
         c.c_mktsegment = 'HOUSEHOLD' AS is_child, c.c_nationkey, c.c_mktsegment
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
)"""

FACT = OA + f""",
fact0 AS (
  SELECT l.l_shipdate, l.l_returnflag, l.l_linestatus, l.l_suppkey, s.s_nationkey AS branch_id,
         oa.patient_hash, oa.is_child, TRY_CAST(substr(oa.o_orderpriority, 1, 1) AS INTEGER) AS payment_type_id,
         CAST(oa.o_totalprice AS DECIMAL(15,2)) AS invoice_amount, p.p_name AS service_name,
         CAST(CAST(l.l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(15,2)) AS amt
  FROM lineitem l JOIN oa ON l.l_orderkey = oa.o_orderkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
fact AS (
  SELECT CAST(l_shipdate AS DATE) AS transaction_date,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS year_month,
         branch_id, patient_hash, is_child, payment_type_id,
         CASE WHEN l_returnflag = 'R' THEN '{vocab.REFUND}' ELSE '{vocab.PAYMENT}' END AS operation_type,
         invoice_amount, service_name, CAST(l_suppkey AS INTEGER) AS doctor_id,
         l_linestatus = 'O' AS is_primary_visit,
         CASE WHEN l_returnflag = 'R' THEN -amt ELSE amt END AS transaction_amount
  FROM fact0
)"""

CF = """cf AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS year_month, c_nationkey AS branch_id,
         o_orderpriority AS line_item, CAST(o_totalprice AS DECIMAL(15,2)) AS amount,
         CASE WHEN o_orderstatus = 'P' THEN 'inflow' ELSE 'outflow' END AS direction,
         c_mktsegment AS cf_group
  FROM oa
)"""

DIM_BRANCH = """dim_branch AS (
  SELECT n_nationkey AS branch_id, n_name AS name, lower(n_name) AS code, n_name AS display_name,
         n_regionkey AS legal_entity_id FROM nation
)"""

DIM_DOCTOR = """dim_doctor AS (
  SELECT CAST(s.s_suppkey AS INTEGER) AS doctor_id, s.s_name AS full_name, r.r_name AS specialization,
         s.s_nationkey AS primary_branch_id
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


def _classify_sql(col: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN instr(lower({col}), '{k.lower()}') > 0 THEN '{v}'" for k, v in rules)
    return f"CASE {whens} ELSE '{default}' END"


DIM_SERVICE = f"""dim_service AS (
  SELECT CAST(min(p_partkey) AS INTEGER) AS service_id, p_name AS name,
         {_classify_sql('p_name', DRIVER_SERVICE_RULES, DRIVER_SERVICE_DEFAULT)} AS category
  FROM part GROUP BY p_name
)"""

COSTS = """costs0 AS (
  SELECT p_name AS service_name, p_type AS service_code,
         CAST(max(p_retailprice) AS DECIMAL(10,2)) AS price,
         CAST(min(p_size) * 10 AS DECIMAL(10,2)) AS material_cost,
         CAST(max(p_size) * 20 AS DECIMAL(10,2)) AS doctor_pay
  FROM part GROUP BY p_name, p_type
),
costs AS (
  SELECT service_code, service_name, price, material_cost, doctor_pay,
         material_cost + doctor_pay AS total_cost, price - (material_cost + doctor_pay) AS margin_rub,
         CASE WHEN price = 0 THEN NULL ELSE CAST(material_cost AS DOUBLE) / CAST(price AS DOUBLE) END AS material_pct,
         CASE WHEN price = 0 THEN NULL ELSE CAST(price - (material_cost + doctor_pay) AS DOUBLE) / CAST(price AS DOUBLE) END AS margin_pct
  FROM costs0
)"""


def _ilike_any(col: str, pats) -> str:
    return "(" + " OR ".join(f"{col} ILIKE '{p}'" for p in pats) + ")"


def _cf_summary_sql(patterns=DRIVER_CF_PATTERNS) -> str:
    parts = []
    for b, pats in patterns.items():
        v = "amount" if b in vocab.CF_SIGNED_BUCKETS else "abs(amount)"
        parts.append(f"SUM({v}) FILTER (WHERE {_ilike_any('line_item', pats)}) AS {b}")
    return "cf_summary AS (\n  SELECT year_month, branch_id,\n    " + ",\n    ".join(parts) + \
        "\n  FROM cf GROUP BY year_month, branch_id\n)"


def _people(keys: str, source: str = "fact") -> str:
    """Distinct patients per group, from the distinct pairs."""
    return f"people AS (SELECT {keys}, COUNT(*) AS who FROM (SELECT DISTINCT {keys}, patient_hash FROM {source} WHERE patient_hash IS NOT NULL) GROUP BY ALL)"


def _same(a: str, b: str, *keys: str) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


def revenue_accrual_sql(source: str = "fact") -> str:
    """Payments and refunds are summed apart, a row of each per month and branch, and put side by side after that."""
    return f"""revenue_accrual AS (
  WITH kinds AS (SELECT year_month, branch_id, operation_type AS kind, SUM(transaction_amount) AS total, SUM(abs(transaction_amount)) AS size,
      COUNT(*) AS n, COUNT(*) FILTER (WHERE is_primary_visit) AS firsts FROM {source} GROUP BY ALL),
  {_people('year_month, branch_id', source)},
  side AS (SELECT year_month, branch_id, SUM(total) AS net_revenue, MAX(CASE kind WHEN 'payment' THEN total END) AS paid, MAX(CASE kind WHEN 'refund' THEN size END) AS back,
      MAX(CASE kind WHEN 'payment' THEN n END) AS n, MAX(CASE kind WHEN 'payment' THEN firsts END) AS firsts FROM kinds GROUP BY ALL)
  SELECT side.year_month, side.branch_id, COALESCE(paid, 0) AS gross_revenue, COALESCE(back, 0) AS refunds, net_revenue,
    COALESCE(who, 0) AS unique_patients, COALESCE(n, 0) AS payment_count, COALESCE(firsts, 0) AS primary_visits, CAST(paid AS DOUBLE) / n AS avg_ticket
  FROM side LEFT JOIN people ON {_same('side', 'people', 'year_month', 'branch_id')})"""


REVENUE_ACCRUAL = revenue_accrual_sql()

# The two halves are stacked and folded by month and branch; a half without a branch has no partner and keeps its own row.
_HALVES = ["net_revenue", "gross_revenue", "refunds", "avg_ticket", "unique_patients", "payment_count", "primary_visits", "cash_revenue",
           "materials", "lab", "payroll_doctors", "payroll_assistants", "rent", "marketing", "it_costs"]
PNL_BODY = f"""halves AS (SELECT 'accrual' AS half, * FROM revenue_accrual UNION ALL BY NAME SELECT 'cash' AS half, * FROM cf_summary),
folded AS (SELECT year_month, branch_id, {', '.join(f'any_value({c}) AS {c}' for c in _HALVES)}
  FROM halves GROUP BY year_month, branch_id, CASE WHEN year_month IS NULL OR branch_id IS NULL THEN half END),
margins AS (SELECT *, COALESCE(net_revenue, 0) - list_sum([COALESCE(x, 0) FOR x IN [materials, lab]]) AS gross_margin,
  list_sum([COALESCE(x, 0) FOR x IN [payroll_doctors, payroll_assistants]]) AS total_payroll_direct,
  list_sum([COALESCE(x, 0) FOR x IN [rent, marketing, it_costs]]) AS overheads FROM folded),
pnl AS (SELECT margins.* EXCLUDE (net_revenue, cash_revenue, overheads), net_revenue AS revenue_accrual, cash_revenue AS revenue_cash,
  gross_margin - total_payroll_direct - overheads AS ebitda, display_name AS branch_name FROM margins LEFT JOIN dim_branch USING (branch_id))"""

PNL_COLUMNS = ["year_month", "branch_id", "branch_name", "revenue_accrual", "revenue_cash",
               "gross_revenue", "refunds", "avg_ticket", "unique_patients", "payment_count",
               "primary_visits", "materials", "lab", "gross_margin", "payroll_doctors",
               "payroll_assistants", "total_payroll_direct", "rent", "marketing", "it_costs", "ebitda"]
MONEY_PNL = [c for c in PNL_COLUMNS if c not in ("year_month", "branch_id", "branch_name", "avg_ticket",
                                                   "unique_patients", "payment_count", "primary_visits")]


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def with_fact(*more: str) -> str:
    return with_(FACT, *more)


def with_pnl(*more: str) -> str:
    """fact + cf + dims + pnl CTE chain."""
    return with_(FACT, CF, DIM_BRANCH, REVENUE_ACCRUAL, _cf_summary_sql(), PNL_BODY, *more)


def dbl(cols, prefix: str = "") -> str:
    return ", ".join(f"CAST({prefix}{c} AS DOUBLE) AS {c}" for c in cols)


def pnl_select(alias: str = "pnl") -> str:
    out = []
    for c in PNL_COLUMNS:
        out.append(f"CAST({alias}.{c} AS DOUBLE) AS {c}" if c in MONEY_PNL else f"{alias}.{c}")
    return ", ".join(out)


CF_SUMMARY = _cf_summary_sql()

# Days first: what a doctor took in a branch on one day, then the month, then the names.
DOCTOR_KPI = f"""doctor_kpi AS (
  WITH days AS (SELECT year_month, doctor_id, branch_id, transaction_date, COUNT(*) FILTER (WHERE operation_type = 'payment') AS n,
      SUM(transaction_amount) FILTER (WHERE operation_type = 'payment') AS took, COUNT(*) FILTER (WHERE operation_type = 'payment' AND is_primary_visit) AS firsts
    FROM fact WHERE doctor_id IS NOT NULL GROUP BY ALL),
  {_people('year_month, doctor_id, branch_id')},
  months AS (SELECT year_month, doctor_id, branch_id, SUM(took) AS revenue, CAST(SUM(n) AS BIGINT) AS visit_count, CAST(SUM(firsts) AS BIGINT) AS primary_visits,
      COUNT(*) FILTER (WHERE n > 0) AS days FROM days GROUP BY ALL)
  SELECT m.year_month, m.doctor_id, full_name AS doctor_name, specialization, m.branch_id, display_name AS branch_name, revenue, visit_count,
    COALESCE(who, 0) AS unique_patients, primary_visits, CAST(revenue AS DOUBLE) / NULLIF(visit_count, 0) AS avg_ticket,
    CAST(revenue AS DOUBLE) / CASE WHEN days = 0 THEN 1 ELSE days END AS revenue_per_workday
  FROM months m LEFT JOIN people ON {_same('m', 'people', 'year_month', 'doctor_id', 'branch_id')}
  LEFT JOIN dim_doctor d ON d.doctor_id = m.doctor_id LEFT JOIN dim_branch b ON b.branch_id = m.branch_id)"""

BRANCH_COMPARISON = f"""branch_comparison AS (
  WITH cells AS (SELECT year_month, branch_id, operation_type = 'payment' AS paid, is_child, is_primary_visit AS is_first, SUM(transaction_amount) AS total, COUNT(*) AS n
    FROM fact GROUP BY ALL),
  {_people('year_month, branch_id')},
  months AS (SELECT year_month, branch_id, SUM(total) FILTER (WHERE paid) AS revenue, SUM(total) AS net_revenue, CAST(COALESCE(SUM(n) FILTER (WHERE paid), 0) AS BIGINT) AS payments,
      CAST(COALESCE(SUM(n) FILTER (WHERE paid AND is_first), 0) AS BIGINT) AS primary_visits,
      SUM(total) FILTER (WHERE paid AND is_child) AS children_revenue, SUM(total) FILTER (WHERE paid AND NOT is_child) AS adult_revenue FROM cells GROUP BY ALL)
  SELECT m.*, display_name AS branch_name, COALESCE(who, 0) AS unique_patients, CAST(revenue AS DOUBLE) / NULLIF(payments, 0) AS avg_ticket
  FROM months m LEFT JOIN people ON {_same('m', 'people', 'year_month', 'branch_id')} LEFT JOIN dim_branch b ON b.branch_id = m.branch_id)"""

# Sales are summed per service and branch before they fan out over the cost rows of the name.
SERVICE_ECONOMICS = """service_economics AS (
  WITH sales AS (SELECT service_name, branch_id, COUNT(*) AS n, SUM(transaction_amount) AS took FROM fact
    WHERE operation_type = 'payment' AND service_name IS NOT NULL GROUP BY ALL),
  triples AS (SELECT service_name, branch_id, material_cost, doctor_pay, margin_pct, CAST(SUM(n) AS BIGINT) AS service_count, SUM(took) AS total_revenue
    FROM sales LEFT JOIN costs USING (service_name) GROUP BY ALL)
  SELECT t.*, CAST(total_revenue AS DOUBLE) / service_count AS avg_price, display_name AS branch_name, s.category
  FROM triples t LEFT JOIN dim_branch b ON b.branch_id = t.branch_id LEFT JOIN dim_service s ON s.name = t.service_name WHERE service_count >= 5)"""

CF_LINES = """cfl AS (SELECT cf.*, b.display_name AS branch_name FROM cf LEFT JOIN dim_branch b ON cf.branch_id = b.branch_id)"""


def with_dk(*more: str) -> str:
    return with_(FACT, DIM_BRANCH, DIM_DOCTOR, DOCTOR_KPI, *more)


def with_bc(*more: str) -> str:
    return with_(FACT, DIM_BRANCH, BRANCH_COMPARISON, *more)


def with_se(*more: str) -> str:
    return with_(FACT, DIM_BRANCH, COSTS, DIM_SERVICE, SERVICE_ECONOMICS, *more)


def with_cf(*more: str) -> str:
    return with_(OA, CF, DIM_BRANCH, CF_LINES, *more)


# SQL spellings of the report aggregate semantics (see operators/_agg.py).
def psum(x: str, as_int: bool = False) -> str:
    return f"CAST(COALESCE(SUM({x}), 0) AS {'BIGINT' if as_int else 'DOUBLE'})"


def fmean(x: str) -> str:
    return f"ROUND(AVG({x}), 6)"


def ratio(a: str, b: str, scale: float = 1.0) -> str:
    r = f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"
    return r if scale == 1.0 else f"({r} * {scale})"


def r6(x: str) -> str:
    return f"ROUND({x}, 6)"
