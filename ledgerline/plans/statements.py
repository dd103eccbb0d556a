"""Computed staging reports (RPT-1..10) as registered queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import statements as T
from ..sources.driver import Warehouse, read
from .registry import query, finish
from . import sqlbase as S
from .sqlbase import ratio, r6, psum

YEARS = (1998, 1999)
LEDGER_PERIOD = (dt.date(1998, 1, 1), dt.date(1998, 12, 31))


def _wh(spark, sf_dir):
    return Warehouse.of(spark, sf_dir)


PAYF = "FILTER (WHERE operation_type = 'payment')"


@query("avg_ticket", S.with_fact() + f"""
SELECT branch_id, COUNT(*) {PAYF} AS visits, CAST(SUM(transaction_amount) {PAYF} AS DOUBLE) AS revenue,
       {ratio(f'SUM(transaction_amount) {PAYF}', f'COUNT(*) {PAYF}')} AS avg_ticket
FROM fact GROUP BY branch_id""")
def avg_ticket(spark, sf_dir):
    return finish(T.avg_ticket(_wh(spark, sf_dir).fact))


@query("ltv_procedures", S.with_fact() + f"""
SELECT service_name, COUNT(DISTINCT patient_hash) AS clients, COUNT(*) AS procedures,
       CAST(SUM(transaction_amount) AS DOUBLE) AS revenue, {ratio('SUM(transaction_amount)', 'COUNT(*)')} AS avg_price,
       CAST(MIN(transaction_amount) AS DOUBLE) AS min_price, CAST(MAX(transaction_amount) AS DOUBLE) AS max_price,
       {ratio('SUM(transaction_amount)', 'COUNT(DISTINCT patient_hash)')} AS revenue_per_client,
       {r6(ratio('COUNT(*)', 'COUNT(DISTINCT patient_hash)'))} AS procedures_per_client
FROM fact WHERE operation_type = 'payment' AND service_name IS NOT NULL GROUP BY service_name""")
def ltv_procedures(spark, sf_dir):
    return finish(T.ltv_procedures(_wh(spark, sf_dir).fact))


@query("top_services_per_branch", S.with_fact("""g AS (SELECT branch_id, service_name, COUNT(*) AS quantity,
  SUM(transaction_amount) AS total FROM fact WHERE operation_type = 'payment' GROUP BY branch_id, service_name),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY branch_id ORDER BY total DESC, service_name ASC) AS rank FROM g)""") + f"""
SELECT branch_id, rank, service_name, {ratio('total', 'quantity')} AS price, quantity, CAST(total AS DOUBLE) AS total
FROM r WHERE rank <= 10""")
def top_services_per_branch(spark, sf_dir):
    return finish(T.top_services_per_branch(_wh(spark, sf_dir).fact, 10))


def _yoy_lines_sql():
    y0, y1 = YEARS
    return S.with_cf(f"""g AS (SELECT line_item,
    COALESCE(SUM(amount) FILTER (WHERE year(year_month) = {y0}), 0) AS amount_base,
    COALESCE(SUM(amount) FILTER (WHERE year(year_month) = {y1}), 0) AS amount_cur
  FROM cfl WHERE year_month BETWEEN DATE '{y0}-01-01' AND DATE '{y1}-12-31' GROUP BY line_item)""",
                     f"""s AS (SELECT *, {ratio('amount_base', 'SUM(amount_base) OVER ()')} AS sb,
                     {ratio('amount_cur', 'SUM(amount_cur) OVER ()')} AS sc FROM g)""") + f"""
SELECT line_item, CAST(amount_base AS DOUBLE) AS amount_base, CAST(amount_cur AS DOUBLE) AS amount_cur,
       {r6('sb')} AS share_base, {r6('sc')} AS share_cur, CAST(amount_cur - amount_base AS DOUBLE) AS delta,
       {r6(f"({ratio('amount_cur', 'amount_base')} - 1.0) * 100.0")} AS delta_pct,
       {r6('(sc - sb) * 100.0')} AS share_delta_pp FROM s"""


@query("yoy_lines", _yoy_lines_sql())
def yoy_lines(spark, sf_dir):
    return finish(T.yoy_lines(_wh(spark, sf_dir).cf_lines, *YEARS))


def ledger(spark, sf_dir):
    """Counterparty ledger from orders x customer: F orders are debits."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        F.to_date("o_orderdate").alias("entry_date"), F.col("c_mktsegment").alias("account"),
        F.col("c_name").alias("counterparty"),
        F.when(F.col("o_orderstatus") == "F", "debit").otherwise("credit").alias("side"),
        F.col("o_totalprice").cast("decimal(15,2)").alias("amount"))


def _ledger_sql():
    lo, hi = (f"DATE '{d}'" for d in LEDGER_PERIOD)
    led = """led AS (SELECT CAST(o.o_orderdate AS DATE) AS entry_date, c.c_mktsegment AS account, c.c_name AS counterparty,
  CASE WHEN o.o_orderstatus = 'F' THEN 'debit' ELSE 'credit' END AS side, CAST(o.o_totalprice AS DECIMAL(15,2)) AS amount
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""
    g = f"""g AS (SELECT account, counterparty,
    COALESCE(SUM(amount) FILTER (WHERE entry_date < {lo} AND side = 'debit'), 0) AS opening_debit,
    COALESCE(SUM(amount) FILTER (WHERE entry_date < {lo} AND side = 'credit'), 0) AS opening_credit,
    COALESCE(SUM(amount) FILTER (WHERE entry_date >= {lo} AND entry_date <= {hi} AND side = 'debit'), 0) AS turnover_debit,
    COALESCE(SUM(amount) FILTER (WHERE entry_date >= {lo} AND entry_date <= {hi} AND side = 'credit'), 0) AS turnover_credit
  FROM led WHERE entry_date <= {hi} GROUP BY account, counterparty)"""
    cols = ["opening_debit", "opening_credit", "turnover_debit", "turnover_credit"]
    return S.with_(led, g) + "SELECT account, counterparty, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols) + \
        ", CAST(opening_debit + turnover_debit AS DOUBLE) AS closing_debit, " \
        "CAST(opening_credit + turnover_credit AS DOUBLE) AS closing_credit FROM g"


@query("supplier_turnover", _ledger_sql())
def supplier_turnover(spark, sf_dir):
    return finish(T.supplier_turnover(ledger(spark, sf_dir), *LEDGER_PERIOD))


def _stmt_lines_sql():
    sums = ", ".join(f"COALESCE(SUM({m}), 0) AS {m}" for _, m in T.STATEMENT_LINES)
    rows = " UNION ALL ".join(f"SELECT legal_entity_id, year, '{c}' AS line_code, '{m}' AS line_name, {m} AS amount_current FROM g"
                              for c, m in T.STATEMENT_LINES)
    return S.with_pnl(f"""g AS (SELECT b.legal_entity_id, CAST(year(p.year_month) AS INTEGER) AS year, {sums}
  FROM pnl p LEFT JOIN dim_branch b ON p.branch_id = b.branch_id GROUP BY 1, 2)""", f"l AS ({rows})") + """
SELECT legal_entity_id, make_date(year, 12, 31) AS period_end, line_code, line_name,
       CAST(amount_current AS DOUBLE) AS amount_current,
       CAST(MAX(amount_current) OVER (PARTITION BY legal_entity_id, line_code ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS amount_previous
FROM l"""


@query("statement_lines", _stmt_lines_sql())
def statement_lines(spark, sf_dir):
    w = _wh(spark, sf_dir)
    return finish(T.statement_lines(w.pnl, w.branches))


@query("patient_stats", S.with_fact(f"""first AS (SELECT patient_hash, MIN(year_month) AS first_month,
    SUM(transaction_amount) {PAYF} AS ltv FROM fact WHERE patient_hash IS NOT NULL GROUP BY patient_hash),
pg AS (SELECT year_month, branch_id, patient_hash, COUNT(*) {PAYF} AS visits, SUM(transaction_amount) {PAYF} AS revenue
  FROM fact WHERE patient_hash IS NOT NULL GROUP BY year_month, branch_id, patient_hash),
g AS (SELECT year_month, branch_id, COUNT(*) AS total_patients,
    COUNT(*) FILTER (WHERE first_month = year_month) AS new_patients, SUM(visits) AS v, SUM(revenue) AS r,
    SUM(ltv) AS l, COUNT(ltv) AS nl
  FROM pg JOIN first USING (patient_hash) GROUP BY year_month, branch_id)""") + f"""
SELECT year_month, branch_id, total_patients, new_patients, total_patients - new_patients AS returning_patients,
       {r6(ratio('total_patients - new_patients', 'total_patients'))} AS retention_rate,
       {r6(ratio('v', 'total_patients'))} AS avg_visits_per_patient,
       {ratio('r', 'total_patients')} AS avg_revenue_per_patient, {ratio('l', 'nl')} AS avg_ltv
FROM g""")
def patient_stats(spark, sf_dir):
    return finish(T.patient_stats(base=_wh(spark, sf_dir).patient_base))


def leads(spark, sf_dir):
    """Lead counts per day from ``events``: signups are primary leads, views secondary."""
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "view"))
    return (e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("count"))
            .select(F.trunc("day", "month").alias("year_month"),
                    F.when(F.col("event_type") == "signup", "primary").otherwise("secondary").alias("lead_type"),
                    "count"))


@query("leads_monthly", S.with_pnl("""lg AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS year_month,
    CASE WHEN event_type = 'signup' THEN 'primary' ELSE 'secondary' END AS lead_type, COUNT(*) AS leads
  FROM events WHERE event_type IN ('signup', 'view') GROUP BY 1, 2)""",
                                   f"pv AS (SELECT year_month, {psum('primary_visits', True)} AS primary_visits FROM pnl GROUP BY year_month)") + f"""
SELECT lg.year_month, lead_type, leads, pv.primary_visits, {r6(ratio('pv.primary_visits', 'leads'))} AS conversion
FROM lg LEFT JOIN pv ON lg.year_month = pv.year_month""")
def leads_monthly(spark, sf_dir):
    return finish(T.leads_monthly(leads(spark, sf_dir), _wh(spark, sf_dir).pnl))


def appointments(spark, sf_dir):
    """Appointment outcomes from orders: F completed, P cancelled, O no-show;
    the clinic is the customer's nation."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    st = F.col("o_orderstatus")
    return o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        F.col("c_nationkey").alias("branch_id"),
        F.when(st == "F", "completed").when(st == "P", "cancelled").when(st == "O", "no_show").alias("status"))


@query("appointment_outcomes", S.with_("""a AS (SELECT c.c_nationkey AS branch_id,
    CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'cancelled' WHEN 'O' THEN 'no_show' END AS status
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)""",
                                        """g AS (SELECT branch_id, COUNT(*) AS appointments,
    COUNT(*) FILTER (WHERE status = 'completed') AS completed, COUNT(*) FILTER (WHERE status = 'cancelled') AS cancelled,
    COUNT(*) FILTER (WHERE status = 'no_show') AS no_show FROM a GROUP BY branch_id)""") + f"""
SELECT *, {r6(ratio('completed', 'appointments'))} AS completed_share, {r6(ratio('cancelled', 'appointments'))} AS cancelled_share,
       {r6(ratio('no_show', 'appointments'))} AS no_show_share FROM g""")
def appointment_outcomes(spark, sf_dir):
    return finish(T.appointment_outcomes(appointments(spark, sf_dir)))


@query("appointment_outcomes_by_doctor", f"""WITH first AS (SELECT l_orderkey, CAST(MIN(l_suppkey) AS INTEGER) AS doctor_id FROM lineitem GROUP BY l_orderkey),
g AS (SELECT c_nationkey AS branch_id, doctor_id, COUNT(*) AS appointments, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS completed,
    COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS cancelled, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS no_show
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN first ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT *, {r6(ratio('completed', 'appointments'))} AS completed_share, {r6(ratio('cancelled', 'appointments'))} AS cancelled_share,
       {r6(ratio('no_show', 'appointments'))} AS no_show_share FROM g""")
def appointment_outcomes_by_doctor(spark, sf_dir):
    """Outcomes per branch and doctor: the doctor is the order's first supplier, unknown for orders without a line."""
    first = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").cast("int").alias("doctor_id"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("branch_id"))
    st = F.col("o_orderstatus")
    appts = (orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left")
             .select("branch_id", "doctor_id", F.when(st == "F", "completed").when(st == "P", "cancelled").when(st == "O", "no_show").alias("status")))
    return finish(T.appointment_outcomes(appts, keys=("branch_id", "doctor_id")))


def invoice_items(spark, sf_dir):
    """Invoice lines from lineitem: clinic = supplier nation, status = return flag,
    paid when the line is closed (``l_linestatus = 'F'``)."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    sub = F.col("l_extendedprice").cast("decimal(15,2)")
    return li.join(s, li.l_suppkey == s.s_suppkey, "left").select(
        F.col("s_nationkey").alias("branch_id"), F.col("l_returnflag").alias("status"), sub.alias("subtotal"),
        (sub * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(15,2)").alias("discount_amount"),
        (F.col("l_linestatus") == "F").alias("paid"))


@query("receivables", S.with_("""it AS (SELECT s.s_nationkey AS branch_id, l.l_returnflag AS status,
    CAST(l.l_extendedprice AS DECIMAL(15,2)) AS subtotal,
    CAST(CAST(l.l_extendedprice AS DECIMAL(15,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS DECIMAL(15,2)) AS discount_amount,
    l.l_linestatus = 'F' AS paid
  FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey)""",
                               """g AS (SELECT branch_id, status, SUM(subtotal) AS subtotal, SUM(discount_amount) AS discount_total,
    SUM(subtotal - discount_amount) AS total_amount,
    COALESCE(SUM(subtotal - discount_amount) FILTER (WHERE paid), 0) AS paid_amount, COUNT(*) AS invoices
  FROM it GROUP BY branch_id, status)""") + """
SELECT branch_id, status, CAST(subtotal AS DOUBLE) AS subtotal, CAST(discount_total AS DOUBLE) AS discount_total,
       CAST(total_amount AS DOUBLE) AS total_amount, CAST(paid_amount AS DOUBLE) AS paid_amount, invoices,
       CAST(total_amount - paid_amount AS DOUBLE) AS debt FROM g""")
def receivables(spark, sf_dir):
    return finish(T.receivables(invoice_items(spark, sf_dir)))


@query("patient_stats_sets", S.with_fact(f"""first AS (SELECT patient_hash, MIN(year_month) AS first_month,
    SUM(transaction_amount) {PAYF} AS ltv FROM fact WHERE patient_hash IS NOT NULL GROUP BY patient_hash),
base AS (SELECT f.year_month, f.branch_id, f.patient_hash, COUNT(*) FILTER (WHERE operation_type = 'payment') AS visits,
    SUM(transaction_amount) FILTER (WHERE operation_type = 'payment') AS revenue
  FROM fact f WHERE patient_hash IS NOT NULL GROUP BY 1, 2, 3),
b2 AS (SELECT base.*, first.ltv, CAST(first.first_month = base.year_month AS INTEGER) AS is_new
  FROM base JOIN first USING (patient_hash)),
per AS (SELECT year_month, branch_id, patient_hash, SUM(visits) AS visits, SUM(revenue) AS revenue, MAX(ltv) AS ltv,
    MAX(is_new) AS is_new, GROUPING(year_month) AS g_ym, GROUPING(branch_id) AS g_br
  FROM b2 GROUP BY GROUPING SETS ((year_month, branch_id, patient_hash), (year_month, patient_hash),
                                  (branch_id, patient_hash), (patient_hash))),
g AS (SELECT g_ym, g_br, year_month, branch_id, COUNT(*) AS total_patients, CAST(SUM(is_new) AS BIGINT) AS new_patients,
    SUM(visits) AS v, SUM(revenue) AS r, SUM(ltv) AS l, COUNT(ltv) AS nl
  FROM per GROUP BY g_ym, g_br, year_month, branch_id)""") + f"""
SELECT CASE WHEN g_ym = 0 AND g_br = 0 THEN 'year_month,branch_id' WHEN g_ym = 0 THEN 'year_month'
            WHEN g_br = 0 THEN 'branch_id' ELSE 'all' END AS level, year_month, branch_id, total_patients, new_patients,
       total_patients - new_patients AS returning_patients,
       {r6(ratio('total_patients - new_patients', 'total_patients'))} AS retention_rate,
       {r6(ratio('v', 'total_patients'))} AS avg_visits_per_patient,
       {ratio('r', 'total_patients')} AS avg_revenue_per_patient, {ratio('l', 'nl')} AS avg_ltv
FROM g""")
def patient_stats_sets(spark, sf_dir):
    return finish(T.patient_stats_sets(base=_wh(spark, sf_dir).patient_base))


def _ages(spark, sf_dir):
    """Ages the driver tables don't have: from the customer's account balance, some unknown."""
    from ..functions import patient_hash
    age = F.pmod(F.floor("c_acctbal"), F.lit(95)).cast("int")
    return read(spark, sf_dir, "customer").select(patient_hash("c_name").alias("patient_hash"), F.when(age < 90, age).alias("age"))


def _report_sql(lo, hi, keys, where="TRUE"):
    """``keys``: (column, output) pairs of the fact."""
    cols = ", ".join(f"{c}" for c, _ in keys)
    group = f"{cols}, " if cols else ""
    out = "".join(f"{e} AS {o}, " for e, o in keys)
    out = out.replace("is_child AS age_group", "CASE WHEN is_child THEN 'child' WHEN NOT is_child THEN 'adult' END AS age_group")
    buckets = ", ".join(f"CAST(COUNT(*) FILTER (WHERE age BETWEEN {lo_} AND {hi_}) AS BIGINT) AS age_{n}"
                        for n, lo_, hi_ in (("0_17", 0, 17), ("18_30", 18, 30), ("31_45", 31, 45), ("46_60", 46, 60), ("60_plus", 61, 999)))
    return S.with_fact(f"""ages AS (SELECT substr(sha256(c_name), 1, 16) AS patient_hash, CASE WHEN a < 90 THEN a END AS age
  FROM (SELECT c_name, ((CAST(floor(c_acctbal) AS BIGINT) % 95) + 95) % 95 AS a FROM customer)),
life AS (SELECT patient_hash, MIN(year_month) AS first_month, SUM(transaction_amount) {PAYF} AS ltv FROM fact WHERE patient_hash IS NOT NULL GROUP BY patient_hash),
p AS (SELECT {group}f.patient_hash, COUNT(*) {PAYF} AS v, SUM(transaction_amount) {PAYF} AS r, any_value(ltv) AS l, bool_or(year_month = first_month) AS new, any_value(age) AS age
  FROM fact f JOIN life USING (patient_hash) LEFT JOIN ages USING (patient_hash) WHERE year_month BETWEEN DATE '{lo}' AND DATE '{hi}' AND {where} GROUP BY {group}f.patient_hash)""") + f"""
SELECT {out}COUNT(*) AS total_patients, COUNT(*) FILTER (WHERE new) AS new_patients, COUNT(*) FILTER (WHERE NOT new) AS returning_patients,
       {r6(ratio('COUNT(*) FILTER (WHERE NOT new)', 'COUNT(*)'))} AS retention_rate, {r6('AVG(age)')} AS avg_age, {buckets},
       {r6(ratio('SUM(v)', 'COUNT(*)'))} AS avg_visits_per_patient, {ratio('SUM(r)', 'COUNT(*)')} AS avg_revenue_per_patient, {ratio('SUM(l)', 'COUNT(l)')} AS avg_ltv
FROM p""" + (f" GROUP BY {cols}" if cols else "")


PERIOD_LO, PERIOD_HI = "1995-01-01", "1996-06-30"


def _report(spark, sf_dir, **kw):
    w = _wh(spark, sf_dir)
    base = w._get("patient_base_by_age_group", lambda: T.patient_base(w.fact, by_age_group=True))
    return finish(T.patient_report(base, _ages(spark, sf_dir), PERIOD_LO, PERIOD_HI, **kw))


@query("patient_report_month_branch", _report_sql(PERIOD_LO, PERIOD_HI, [("year_month", "year_month"), ("branch_id", "branch_id")]))
def patient_report_month_branch(spark, sf_dir):
    return _report(spark, sf_dir)


@query("patient_report_age_group", _report_sql(PERIOD_LO, PERIOD_HI, [("is_child", "age_group")], "branch_id = 7"))
def patient_report_age_group(spark, sf_dir):
    return _report(spark, sf_dir, group_by=["age_group"], branch_id=7)


@query("patient_report_adults", _report_sql(PERIOD_LO, PERIOD_HI, [("branch_id", "branch_id")], "is_child = FALSE"))
def patient_report_adults(spark, sf_dir):
    return _report(spark, sf_dir, group_by=["branch"], age_group="adult")


@query("distinct_patients_period", S.with_fact() + f"""
SELECT 'period' AS scope, NULL::INTEGER AS branch_id, COUNT(DISTINCT patient_hash) AS distinct_patients FROM fact WHERE year_month BETWEEN DATE '{PERIOD_LO}' AND DATE '{PERIOD_HI}'
UNION ALL SELECT 'branch', branch_id, COUNT(DISTINCT patient_hash) FROM fact WHERE year_month BETWEEN DATE '{PERIOD_LO}' AND DATE '{PERIOD_HI}' AND branch_id IS NOT NULL GROUP BY branch_id""")
def distinct_patients_period(spark, sf_dir):
    """True distinct patients of a period, in all and per branch, from bitmaps made per month and branch."""
    from ..operators import patients as PA
    w = _wh(spark, sf_dir)
    bits = w._get("patient_bitmaps", lambda: PA.patient_bitmaps(w.fact, PA.patient_numbers(w.fact)))
    bits = bits.where(F.col("year_month").between(F.lit(PERIOD_LO).cast("date"), F.lit(PERIOD_HI).cast("date")))
    whole = PA.distinct_patients(bits).select(F.lit("period").alias("scope"), F.lit(None).cast("int").alias("branch_id"), "distinct_patients")
    per = PA.distinct_patients(bits.where("branch_id IS NOT NULL"), ["branch_id"]).select(F.lit("branch").alias("scope"), "branch_id", "distinct_patients")
    return whole.unionByName(per)
