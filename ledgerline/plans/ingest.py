"""Ingest, grid, JSON, conforming and dimension operators as registered queries.

Each query renders whole driver tables into the operator's natural input
(``sources/feeds.py``) and runs the operator; the oracle computes the
expected rows directly from the driver tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import vocab, schemas as SC
from ..operators import conform as C
from ..operators import filters as FL
from ..sources import feeds as FD, files as FI, grid as G, api as A, calendar as CAL
from ..sources.driver import Warehouse, read, dim_branch, DRIVER_SERVICE_RULES, DRIVER_SERVICE_DEFAULT
from .registry import query, finish
from . import sqlbase as S


def _esc(s: str) -> str:
    return s.replace("'", "''")


def _case(col: str, mapping: dict, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{_esc(k)}' THEN '{_esc(v)}'" for k, v in mapping.items()) + f" ELSE {default} END"


OFR = """ofr AS (SELECT o.*, c.c_name, c.c_nationkey, c.c_mktsegment, n.n_name, n.n_regionkey,
  substr(sha256(c.c_name), 1, 16) AS patient_hash
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

SRC = OFR + """,
src AS (SELECT l.*, ofr.*, s.s_suppkey, s.s_name, p.p_name,
  CAST(CAST(l.l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(15,2)) AS amt
  FROM lineitem l JOIN ofr ON l.l_orderkey = ofr.o_orderkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""

TRIMMED_PAYMENT = {k: v.strip() for k, v in FD.PRIORITY_PAYMENT.items()}
PAYMENT_IDS = {n: i + 1 for i, (n, _) in enumerate(vocab.PAYMENT_TYPES)}

CLINIC_SQL = """CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'Unknown clinic'
  WHEN o_orderpriority = '1-URGENT' THEN '(' || n_name || ')' WHEN o_orderpriority = '2-HIGH' THEN upper(n_name)
  ELSE n_name END"""

TX_EXPECTED = f"""tx AS (SELECT CAST(l_shipdate AS DATE) AS transaction_date, {CLINIC_SQL} AS clinic,
  CASE WHEN c_mktsegment = 'BUILDING' AND o_orderstatus = 'P' THEN NULL ELSE patient_hash END AS patient_hash,
  CAST(NULL AS INTEGER) AS patient_age,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '{vocab.SOURCE_CHILD_LABEL}' ELSE 'Взрослый' END AS age_group,
  {_case('o_orderpriority', TRIMMED_PAYMENT)} AS payment_type,
  CASE WHEN l_returnflag = 'R' THEN '{vocab.SOURCE_REFUND_LABEL}' ELSE '{vocab.SOURCE_PAYMENT_LABEL}' END AS operation_type,
  n_name AS invoice_clinic, CAST(o_totalprice AS DECIMAL(15,2)) AS invoice_amount, CAST(0 AS DECIMAL(15,2)) AS invoice_debt,
  o_orderstatus AS invoice_status, substr(p_name, 1, 200) AS service_items, CAST(l_shipdate AS DATE) AS visit_date,
  'Осмотр' AS visit_reasons, s_name AS doctor_name, s_suppkey,
  CASE WHEN l_linestatus = 'O' THEN '{vocab.SOURCE_PRIMARY_LABEL}' ELSE 'Повторный' END AS visit_status,
  CASE WHEN l_returnflag = 'R' THEN -amt ELSE amt END AS transaction_amount, c_nationkey
  FROM src WHERE l_quantity < 50 AND l_discount <> 0.1)"""

TX_COLS = ["transaction_date", "clinic", "patient_hash", "patient_age", "age_group", "payment_type", "operation_type",
           "invoice_clinic", "invoice_amount", "invoice_debt", "invoice_status", "service_items", "visit_date",
           "visit_reasons", "doctor_name", "visit_status", "transaction_amount"]
MONEY_COLS = {"invoice_amount", "invoice_debt", "transaction_amount", "amount", "subtotal", "discount_total",
              "total_amount", "paid_amount", "debt", "price", "material_cost", "doctor_pay", "assistant_pay", "taxes",
              "total_cost", "margin_rub", "invoice_total_amount", "invoice_discount_amount", "invoice_discount_percent",
              "service_price", "service_discount", "service_total", "base_price", "min_branch_price",
              "avg_revenue_per_patient", "avg_ltv"}


def _sel(cols, prefix: str = "") -> str:
    return ", ".join(f"CAST({prefix}{c} AS DOUBLE) AS {c}" if c in MONEY_COLS else f"{prefix}{c}" for c in cols)


def _csv(spark, sf_dir, name, columns=None):
    """Landed CSV read with an all-string schema (header row skipped)."""
    path = FD.landed(spark, sf_dir, name)
    if columns is None:  # data-dependent header (week columns): names from the header, all text
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    return FI.read_flat(spark, path, columns, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _json(spark, sf_dir, name, schema):
    return A.read_records(spark, FD.landed(spark, sf_dir, name), schema)


def _tx_raw(spark, sf_dir):
    return _csv(spark, sf_dir, "transactions", list(vocab.TRANSACTION_COLUMNS))


def _typed(spark, sf_dir):
    return FI.transactions_typed(_tx_raw(spark, sf_dir))


@query("ingest_transactions", S.with_(SRC, TX_EXPECTED) + f"SELECT {_sel(TX_COLS)} FROM tx")
def ingest_transactions(spark, sf_dir):
    return finish(FI.ingest_transactions(_tx_raw(spark, sf_dir)))


@query("dq_rejects", S.with_(SRC) + """SELECT COUNT(*) AS rows,
  COUNT(*) FILTER (WHERE l_quantity >= 50 OR l_discount = 0.1) AS rejected,
  COUNT(*) FILTER (WHERE l_quantity >= 50) AS null_transaction_date,
  COUNT(*) FILTER (WHERE l_discount = 0.1) AS null_transaction_amount FROM src""")
def dq_rejects(spark, sf_dir):
    return FI.reject_counts(_typed(spark, sf_dir))


def _payment_types(spark):
    from ..sources.seeds import payment_types
    return payment_types(spark)


def _doctors(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_name").alias("full_name"),
                                                  F.col("s_suppkey").cast("int").alias("doctor_id"))


FACT_COLS = ["transaction_date", "year_month", "branch_id", "patient_hash", "patient_age", "is_child", "payment_type_id",
             "operation_type", "invoice_branch_id", "invoice_amount", "invoice_debt", "service_name", "visit_date",
             "doctor_id", "is_primary_visit", "transaction_amount"]


@query("conform_fact", S.with_(SRC, TX_EXPECTED) + f"""
SELECT transaction_date, CAST(date_trunc('month', transaction_date) AS DATE) AS year_month,
  CASE WHEN clinic = 'Unknown clinic' THEN NULL ELSE c_nationkey END AS branch_id, patient_hash, patient_age,
  age_group = '{vocab.SOURCE_CHILD_LABEL}' AS is_child,
  {_case('payment_type', {k: str(v) for k, v in PAYMENT_IDS.items()})}::INTEGER AS payment_type_id,
  CASE WHEN operation_type = '{vocab.SOURCE_PAYMENT_LABEL}' THEN 'payment' ELSE 'refund' END AS operation_type,
  c_nationkey AS invoice_branch_id, CAST(invoice_amount AS DOUBLE) AS invoice_amount, CAST(invoice_debt AS DOUBLE) AS invoice_debt,
  service_items AS service_name, visit_date, CAST(s_suppkey AS INTEGER) AS doctor_id,
  visit_status = '{vocab.SOURCE_PRIMARY_LABEL}' AS is_primary_visit, CAST(transaction_amount AS DOUBLE) AS transaction_amount
FROM tx""")
def conform_fact(spark, sf_dir):
    tx = FI.ingest_transactions(_tx_raw(spark, sf_dir))
    f = C.conform_fact(tx, FD.branch_aliases(spark, sf_dir), dim_branch(spark, sf_dir), _payment_types(spark),
                       _doctors(spark, sf_dir))
    return finish(f.select(*FACT_COLS))


CF_COLS = ["entry_type", "direction", "month_num", "entry_date", "document", "description", "debit_account",
           "credit_account", "amount", "counterparty", "branch_uu", "account_uu", "expense_category", "source_file"]
CF_EXPECTED = OFR + """,
cfe AS (SELECT 'operating' AS entry_type, CASE WHEN o_orderstatus = 'P' THEN 'inflow' ELSE 'outflow' END AS direction,
  CAST(month(o_orderdate) AS INTEGER) AS month_num, CAST(o_orderdate AS DATE) AS entry_date,
  'DOC-' || CAST(o_orderkey AS VARCHAR) AS document, o_orderpriority AS description, '51' AS debit_account,
  '62' AS credit_account, CAST(o_totalprice AS DECIMAL(15,2)) AS amount, c_name AS counterparty,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '(' || n_name || ')' WHEN o_orderpriority = '2-HIGH' THEN upper(n_name)
       WHEN o_orderpriority = '3-MEDIUM' THEN '  ' || n_name || ' ' ELSE n_name END AS branch_uu,
  c_mktsegment AS account_uu, o_orderpriority AS expense_category, 'cf_journal.csv' AS source_file, c_nationkey
  FROM ofr WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW'))"""


def _cf_entries(spark, sf_dir):
    return FI.ingest_cf_entries(_csv(spark, sf_dir, "cf_journal", list(vocab.CF_ENTRY_COLUMNS)),
                                source_file="cf_journal.csv")


@query("ingest_cf_entries", S.with_(CF_EXPECTED) + f"SELECT {_sel(CF_COLS)} FROM cfe")
def ingest_cf_entries(spark, sf_dir):
    return finish(_cf_entries(spark, sf_dir))


@query("conform_cf_entries", S.with_(CF_EXPECTED) + f"SELECT {_sel(CF_COLS)}, c_nationkey AS branch_id FROM cfe")
def conform_cf_entries(spark, sf_dir):
    return finish(C.conform_cf_entries(_cf_entries(spark, sf_dir), FD.branch_aliases(spark, sf_dir),
                                       dim_branch(spark, sf_dir)))


COST_COLS = ["service_code", "service_name", "price", "material_cost", "doctor_pay", "assistant_pay", "taxes",
             "total_cost", "material_pct", "margin_rub", "margin_pct"]


@query("ingest_cost_structure", S.with_("""cs AS (SELECT CAST(p_partkey AS VARCHAR) AS service_code, p_name AS service_name,
  CAST(p_retailprice AS DECIMAL(10,2)) AS price, CAST(p_size * 10 AS DECIMAL(10,2)) AS material_cost,
  CAST(p_size * 20 AS DECIMAL(10,2)) AS doctor_pay, CAST(0 AS DECIMAL(10,2)) AS assistant_pay,
  CAST(NULL AS DECIMAL(10,2)) AS taxes, CAST(p_size * 30 AS DECIMAL(10,2)) AS total_cost
  FROM part WHERE p_size <> 1 AND p_size <> 50)""") + f"""
SELECT {_sel(COST_COLS[:8])}, CAST(material_cost AS DOUBLE) / CAST(price AS DOUBLE) AS material_pct,
  CAST(price - total_cost AS DOUBLE) AS margin_rub, CAST(price - total_cost AS DOUBLE) / CAST(price AS DOUBLE) AS margin_pct FROM cs""")
def ingest_cost_structure(spark, sf_dir):
    return finish(FI.ingest_cost_structure(_csv(spark, sf_dir, "cost_sheet", list(vocab.COST_COLUMNS))))


@query("unpivot_leads", f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
  {_case('o_orderpriority', {k: FD.PRIORITY_LEAD[k] for k in ('1-URGENT', '2-HIGH')})} AS lead_type,
  CAST(COUNT(*) AS INTEGER) AS count
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2, 3""")
def unpivot_leads(spark, sf_dir):
    cols = [vocab.LEAD_LABEL_COLUMN, "year"] + vocab.MONTH_NAMES
    return FI.unpivot_leads(_csv(spark, sf_dir, "leads_sheet", cols), year="year")


@query("lead_sources_weekly", """SELECT event_type AS source, CAST(date_trunc('week', ts) AS DATE) AS week_start,
  CAST(date_trunc('week', ts) AS DATE) + 6 AS week_end, CAST(COUNT(*) AS INTEGER) AS count FROM events GROUP BY 1, 2, 3""")
def lead_sources_weekly(spark, sf_dir):
    return FI.lead_sources_weekly(_csv(spark, sf_dir, "weekly_sources"))


SVOD_EXPECTED = OFR + """,
sv AS (SELECT CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) AS year_month_str,
  r.r_name AS legal_entity, r.r_regionkey, o_orderpriority AS line_item,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS amount, 'cf_svod.xlsx' AS source_file,
  year(o_orderdate) AS y, month(o_orderdate) AS m
  FROM ofr LEFT JOIN region r ON ofr.n_regionkey = r.r_regionkey
  WHERE o_orderpriority <> '4-NOT SPECIFIED' AND NOT (o_orderpriority = '3-MEDIUM' AND r.r_regionkey = 0)
  GROUP BY 1, 2, 3, 4, 7, 8 HAVING SUM(o_totalprice) <> 0)"""


def _svod(spark, sf_dir):
    return G.grid_unpivot_svod(spark.read.parquet(FD.landed(spark, sf_dir, "svod_cells")))


@query("grid_unpivot_svod", S.with_(SVOD_EXPECTED) + "SELECT year_month_str, legal_entity, line_item, amount, source_file FROM sv")
def grid_unpivot_svod(spark, sf_dir):
    return finish(_svod(spark, sf_dir))


@query("cf_monthly_conform", S.with_(SVOD_EXPECTED) + """SELECT make_date(y, m, 1) AS year_month,
  r_regionkey AS legal_entity_id, CAST(NULL AS INTEGER) AS branch_id, line_item, amount, source_file FROM sv""")
def cf_monthly_conform(spark, sf_dir):
    ent = read(spark, sf_dir, "region").select(F.col("r_name").alias("short_name"), F.col("r_regionkey").alias("legal_entity_id"))
    return finish(C.cf_monthly_conform(_svod(spark, sf_dir), ent))


@query("grid_unpivot_clinics", S.with_(OFR) + """SELECT n_name AS branch, o_orderpriority AS line_item,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS amount,
  'cf_clinics_' || strftime(o_orderdate, '%Y_%m') || '.xlsx' AS source_file
FROM ofr WHERE n_regionkey <> 4 GROUP BY 1, 2, 4""")
def grid_unpivot_clinics(spark, sf_dir):
    allowed = read(spark, sf_dir, "nation").where(F.col("n_regionkey") != 4).select("n_name")
    return finish(G.grid_unpivot_clinics(spark.read.parquet(FD.landed(spark, sf_dir, "clinics_cells")), allowed))


@query("fact_cf_monthly", S.with_(SVOD_EXPECTED) + """SELECT make_date(y, m, 1) AS year_month, r_regionkey AS legal_entity_id,
  CAST(NULL AS INTEGER) AS branch_id, line_item, amount, source_file FROM sv
UNION ALL SELECT CAST(date_trunc('month', o_orderdate) AS DATE), n_regionkey, c_nationkey, o_orderpriority,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE), 'cf_clinics_' || strftime(o_orderdate, '%Y_%m') || '.xlsx'
FROM ofr WHERE n_regionkey <> 4 GROUP BY ALL""")
def fact_cf_monthly(spark, sf_dir):
    """Both grids as one monthly cash-flow fact: consolidated rows by legal entity, clinic rows by branch."""
    ent = read(spark, sf_dir, "region").select(F.col("r_name").alias("short_name"), F.col("r_regionkey").alias("legal_entity_id"))
    allowed = read(spark, sf_dir, "nation").where(F.col("n_regionkey") != 4).select("n_name")
    clinics = G.grid_unpivot_clinics(spark.read.parquet(FD.landed(spark, sf_dir, "clinics_cells")), allowed)
    branches = dim_branch(spark, sf_dir)
    aliases = branches.select(F.col("name").alias("alias"), "code")
    return finish(C.cf_monthly_conform(_svod(spark, sf_dir), ent).unionByName(C.cf_clinics_conform(clinics, aliases, branches)))


# ----------------------------------------------------------------- JSON ----
LINES = """lines AS (SELECT l_orderkey, list_sort(list(struct_pack(service_id := CAST(l_partkey AS INTEGER), code := p_type,
    name := p_name, category := p_type, quantity := CAST(l_quantity AS INTEGER),
    price := CAST(l_extendedprice AS DECIMAL(10,2)), discount := CAST(l_discount AS DECIMAL(10,2)),
    total := CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(15,2))))) AS sv,
  COUNT(*) AS n, SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS subtotal,
  SUM(CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(15,2))) AS discount_total,
  MIN(l_suppkey) AS supp
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""

AGE_GROUP = "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'child' ELSE 'adult' END"

FLAT_TX = f"""ft AS (SELECT o_orderkey AS transaction_id_api, CAST(o_orderdate AS DATE) AS transaction_date,
  o_orderdate AS transaction_datetime, c_nationkey AS branch_id_api, ofr.n_name AS branch_name, lower(ofr.n_name) AS branch_code,
  patient_hash AS patient_id, CAST(NULL AS INTEGER) AS patient_age, {AGE_GROUP} AS patient_age_group,
  {AGE_GROUP} = 'child' AS is_child, substr(o_orderpriority, 1, 1) AS payment_type_code,
  o_orderpriority AS payment_type_name, CASE WHEN o_orderstatus = 'P' THEN 'refund' ELSE 'payment' END AS operation_type,
  'INV-' || CAST(o_orderkey AS VARCHAR) AS invoice_id, CAST(o_totalprice AS DECIMAL(15,2)) AS invoice_total_amount,
  CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(15,2)) ELSE 0 END AS invoice_debt,
  o_orderstatus AS invoice_status, CAST(NULL AS DOUBLE) AS invoice_discount_amount, CAST(NULL AS DOUBLE) AS invoice_discount_percent,
  sv[1].service_id AS service_id_api, sv[1].code AS service_code, sv[1].name AS service_name,
  sv[1].category AS service_category, sv[1].quantity AS service_quantity, sv[1].price AS service_price,
  sv[1].discount AS service_discount, sv[1].total AS service_total, CAST(n AS INTEGER) AS services_count,
  CAST(s.s_suppkey AS INTEGER) AS doctor_id_api, s.s_name AS doctor_name, dr.r_name AS doctor_specialization,
  CAST(o_orderdate AS DATE) AS visit_date, CASE WHEN o_orderpriority = '1-URGENT' THEN 'primary' ELSE 'repeat' END AS visit_type,
  CAST(NULL AS VARCHAR) AS visit_reason, o_orderpriority = '1-URGENT' AS is_primary_visit,
  CAST(o_totalprice AS DECIMAL(15,2)) AS amount, o_orderdate AS created_at, o_orderdate AS updated_at
  FROM ofr JOIN lines ON o_orderkey = l_orderkey LEFT JOIN supplier s ON supp = s.s_suppkey
  LEFT JOIN nation dn ON s.s_nationkey = dn.n_nationkey LEFT JOIN region dr ON dn.n_regionkey = dr.r_regionkey)"""
FLAT_TX_COLS = ["transaction_id_api", "transaction_date", "transaction_datetime", "branch_id_api", "branch_name",
                "branch_code", "patient_id", "patient_age", "patient_age_group", "is_child", "payment_type_code",
                "payment_type_name", "operation_type", "invoice_id", "invoice_total_amount", "invoice_debt",
                "invoice_status", "invoice_discount_amount", "invoice_discount_percent", "service_id_api",
                "service_code", "service_name", "service_category", "service_quantity", "service_price",
                "service_discount", "service_total", "services_count", "doctor_id_api", "doctor_name",
                "doctor_specialization", "visit_date", "visit_type", "visit_reason", "is_primary_visit", "amount",
                "created_at", "updated_at"]


def _flat_tx(spark, sf_dir):
    return A.flatten_transactions(_json(spark, sf_dir, "transactions_json", SC.TRANSACTION))


@query("flatten_transactions", S.with_(OFR, LINES, FLAT_TX) + f"SELECT {_sel(FLAT_TX_COLS)} FROM ft")
def flatten_transactions(spark, sf_dir):
    return finish(_flat_tx(spark, sf_dir))


@query("conform_api_fact", S.with_(OFR, LINES, FLAT_TX) + """SELECT transaction_date,
  CAST(date_trunc('month', transaction_date) AS DATE) AS year_month, n_nationkey AS branch_id, patient_id AS patient_hash,
  patient_age, is_child, p.id AS payment_type_id, operation_type,
  CAST(invoice_total_amount AS DOUBLE) AS invoice_amount, CAST(invoice_debt AS DOUBLE) AS invoice_debt, sv.id AS service_id, service_name,
  visit_date, s_id AS doctor_id, is_primary_visit, CAST(amount AS DOUBLE) AS transaction_amount
FROM ft LEFT JOIN nation ON lower(n_name) = branch_code LEFT JOIN (VALUES ('1', 50), ('2', 40), ('3', 30), ('4', 20)) p(code, id) ON p.code = payment_type_code
LEFT JOIN (SELECT p_name, CAST(MIN(p_partkey) AS INTEGER) AS id FROM part GROUP BY p_name) sv ON p_name = service_name
LEFT JOIN (SELECT s_name, CAST(MIN(s_suppkey) AS INTEGER) AS s_id FROM supplier GROUP BY s_name) ON s_name = doctor_name""")
def conform_api_fact(spark, sf_dir):
    """Ids come from the dimensions; the payment types know four of the feed's five codes."""
    from ..sources.seeds import local_table
    codes = local_table(spark, [("1", 50), ("2", 40), ("3", 30), ("4", 20)], "code string, payment_type_id int")
    w = Warehouse.of(spark, sf_dir)
    return finish(C.conform_api_fact(_flat_tx(spark, sf_dir), w.branches, codes, w.services, w.doctors))


@query("flatten_doctors", S.with_("""ty AS (SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT p_type)), ', ') AS specs
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey)""",
                                  """sb AS (SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT c.c_nationkey)), ', ') AS ids
  FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n2 ON c.c_nationkey = n2.n_nationkey GROUP BY l_suppkey)""") + """
SELECT CAST(s.s_suppkey AS INTEGER) AS doctor_id_api, s.s_name AS full_name, 'S' || substr(s.s_name, 9, 20) AS short_name,
  r.r_name AS specialization, COALESCE(ty.specs, '') AS additional_specializations, s.s_nationkey AS primary_branch_id,
  n.n_name AS primary_branch_name, COALESCE(sb.ids, '') AS branch_ids, s.s_acctbal > 0 AS is_active,
  CAST(NULL AS DATE) AS hire_date, CAST(NULL AS TIMESTAMP) AS updated_at
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN ty ON s.s_suppkey = ty.l_suppkey LEFT JOIN sb ON s.s_suppkey = sb.l_suppkey""")
def flatten_doctors(spark, sf_dir):
    return A.flatten_doctors(_json(spark, sf_dir, "doctors_json", SC.DOCTOR))


@query("flatten_branches", """WITH k AS (SELECT s_nationkey, CAST(COUNT(*) AS INTEGER) AS k FROM supplier GROUP BY s_nationkey)
SELECT n_nationkey AS branch_id_api, n_name AS name, lower(n_name) AS code, CAST(NULL AS VARCHAR) AS address,
  CAST(NULL AS VARCHAR) AS phone, k.k AS chairs_count, k.k AS doctors_count, TRUE AS is_active, CAST(NULL AS DATE) AS opened_date,
  CAST(to_json(MAP {'mon': '09:00-21:00', 'sat': '10:00-18:00',
                    'sun': CASE WHEN n_regionkey = 0 THEN NULL ELSE '10:00-16:00' END}) AS VARCHAR) AS working_hours,
  CAST(NULL AS TIMESTAMP) AS updated_at
FROM nation LEFT JOIN k ON n_nationkey = k.s_nationkey""")
def flatten_branches(spark, sf_dir):
    return A.flatten_branches(_json(spark, sf_dir, "branches_json", SC.BRANCH))


def _classify_sql(col: str) -> str:
    whens = " ".join(f"WHEN instr(lower({col}), '{k.lower()}') > 0 THEN '{v}'" for k, v in DRIVER_SERVICE_RULES)
    return f"CASE {whens} ELSE '{DRIVER_SERVICE_DEFAULT}' END"


@query("flatten_services", f"""SELECT CAST(min(p_partkey) AS INTEGER) AS service_id_api, min(p_type) AS code, p_name AS name,
  {_classify_sql('p_name')} AS category, CAST(NULL AS VARCHAR) AS subcategory,
  CAST(min(CAST(p_retailprice AS DECIMAL(10,2))) AS DOUBLE) AS base_price, 30 AS duration_minutes, TRUE AS is_active,
  CAST(NULL AS TIMESTAMP) AS updated_at, CAST(COUNT(DISTINCT p_brand) AS INTEGER) AS branch_prices,
  CAST(min(CAST(p_retailprice AS DECIMAL(10,2))) AS DOUBLE) AS min_branch_price
FROM part GROUP BY p_name""")
def flatten_services(spark, sf_dir):
    return finish(A.flatten_services(_json(spark, sf_dir, "services_json", SC.SERVICE)))


@query("flatten_appointments", S.with_(OFR) + f"""SELECT o_orderkey AS appointment_id_api, CAST(o_orderdate AS DATE) AS date,
  '09:00' AS time_start, '09:30' AS time_end, 30 AS duration_minutes, c_nationkey AS branch_id_api, n_name AS branch_name,
  CAST(NULL AS INTEGER) AS doctor_id_api, CAST(NULL AS VARCHAR) AS doctor_name, CAST(NULL AS VARCHAR) AS doctor_specialization,
  patient_hash AS patient_id, CAST(NULL AS INTEGER) AS patient_age, {AGE_GROUP} AS patient_age_group,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'primary' ELSE 'repeat' END AS visit_type, CAST(NULL AS VARCHAR) AS reason,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'cancelled' WHEN 'O' THEN 'no_show' END AS status,
  o_orderpriority AS source, o_orderdate AS created_at, o_orderdate AS updated_at FROM ofr""")
def flatten_appointments(spark, sf_dir):
    return A.flatten_appointments(_json(spark, sf_dir, "appointments_json", SC.APPOINTMENT))


@query("flatten_invoices", S.with_(OFR, LINES) + f"""SELECT 'INV-' || CAST(o_orderkey AS VARCHAR) AS invoice_id,
  CAST(o_orderdate AS DATE) AS created_date, c_nationkey AS branch_id_api, n_name AS branch_name, patient_hash AS patient_id,
  {AGE_GROUP} AS patient_age_group, CAST(NULL AS INTEGER) AS doctor_id_api, CAST(NULL AS VARCHAR) AS doctor_name,
  CAST(subtotal AS DOUBLE) AS subtotal, CAST(discount_total AS DOUBLE) AS discount_total,
  CAST(subtotal - discount_total AS DOUBLE) AS total_amount,
  CAST(CASE WHEN o_orderstatus = 'F' THEN subtotal - discount_total ELSE 0 END AS DOUBLE) AS paid_amount,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE subtotal - discount_total END AS DOUBLE) AS debt, o_orderstatus AS status,
  CAST(n AS INTEGER) AS items_count, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS payments_count,
  o_orderdate AS created_at, o_orderdate AS updated_at FROM ofr JOIN lines ON o_orderkey = l_orderkey""")
def flatten_invoices(spark, sf_dir):
    return finish(A.flatten_invoices(_json(spark, sf_dir, "invoices_json", SC.INVOICE)))


@query("flatten_patient_stats", S.with_(OFR) + "SELECT strftime(o_orderdate, '%Y-%m') AS period, c_nationkey AS branch_id_api, "
       "n_name AS branch_name, CAST(COUNT(DISTINCT o_custkey) AS INTEGER) AS total_patients, CAST(NULL AS INTEGER) AS new_patients, "
       "CAST(NULL AS INTEGER) AS returning_patients, CAST(NULL AS DOUBLE) AS retention_rate, CAST(NULL AS DOUBLE) AS avg_age, " +
       ", ".join(f"CAST(COUNT(DISTINCT CASE WHEN c_mktsegment = '{s}' THEN o_custkey END) AS INTEGER) AS age_{b}"
                 for s, b in FD.SEGMENT_BUCKET.items()) +
       ", CAST(COUNT(*) AS DOUBLE) / CAST(COUNT(DISTINCT o_custkey) AS DOUBLE) AS avg_visits_per_patient, "
       "CAST(NULL AS DOUBLE) AS avg_revenue_per_patient, CAST(NULL AS DOUBLE) AS avg_ltv FROM ofr GROUP BY 1, 2, 3")
def flatten_patient_stats(spark, sf_dir):
    return finish(A.flatten_patient_stats(_json(spark, sf_dir, "patient_stats_json", SC.PATIENT_STATS)))


@query("explode_pages", S.with_(OFR) + f"""SELECT CAST(floor(o_orderkey / {FD.PAGE_SIZE}) AS BIGINT) AS page_no,
  o_orderkey AS transaction_id, CAST(o_orderdate AS DATE) AS transaction_date, c_nationkey AS branch_id,
  CASE WHEN o_orderstatus = 'P' THEN 'refund' ELSE 'payment' END AS operation_type,
  CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) AS amount FROM ofr""")
def explode_pages(spark, sf_dir):
    pages = _json(spark, sf_dir, "transaction_pages", SC.synced(SC.envelope(SC.TRANSACTION)))
    r = A.explode_pages(pages, keys=["sync_id"])
    return finish(r.select("page_no", "transaction_id", "transaction_date", F.col("branch.id").alias("branch_id"),
                           "operation_type", "amount"))


# ------------------------------------------------------ dimensions etc. ----
@query("resolve_branch", S.with_(OFR) + f"""SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' THEN '  ' || n_name || ' '
  ELSE {CLINIC_SQL} END AS clinic, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE c_nationkey END AS branch_id
FROM ofr""")
def resolve_branch(spark, sf_dir):
    x = FD._order_frame(spark, sf_dir)
    x = x.select("o_orderkey", FD.clinic_variant(F.col("n_name"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("clinic"))
    return C.resolve_branch(x, "clinic", FD.branch_aliases(spark, sf_dir), dim_branch(spark, sf_dir))


KNOWN_ADJ = ("red", "blue", "small", "large")


def _known_services(spark, sf_dir):
    from ..functions import classify_by_rules
    p = read(spark, sf_dir, "part").where(F.split("p_name", " ").getItem(0).isin(*KNOWN_ADJ))
    return (p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("int").alias("service_id"))
            .withColumn("category", classify_by_rules("name", DRIVER_SERVICE_RULES, DRIVER_SERVICE_DEFAULT)))


UPSERT_SQL = S.with_(f"""ex AS (SELECT CAST(min(p_partkey) AS INTEGER) AS service_id, p_name AS name, {_classify_sql('p_name')} AS category
  FROM part WHERE split_part(p_name, ' ', 1) IN ({', '.join(f"'{a}'" for a in KNOWN_ADJ)}) GROUP BY p_name)""",
                     """inc AS (SELECT DISTINCT trim(p.p_name) AS name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_name IS NOT NULL AND length(trim(p.p_name)) > 0)""",
                     f"""nw AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY name) + (SELECT COALESCE(max(service_id), 0) FROM ex) AS INTEGER) AS service_id,
  name, {_classify_sql('name')} AS category FROM inc WHERE name NOT IN (SELECT name FROM ex))""")


@query("upsert_dimension", UPSERT_SQL + "SELECT service_id, name, category, FALSE AS is_new FROM ex UNION ALL "
       "SELECT service_id, name, category, TRUE FROM nw")
def upsert_dimension(spark, sf_dir):
    inc = Warehouse.of(spark, sf_dir).fact.select("service_name")
    return C.upsert_dimension(inc, _known_services(spark, sf_dir), "service_name", "service_id", dim_key="name",
                              rules=DRIVER_SERVICE_RULES, default=DRIVER_SERVICE_DEFAULT)


@query("dim_insert_new", UPSERT_SQL + "SELECT service_id, name, category FROM nw")
def dim_insert_new(spark, sf_dir):
    d = upsert_dimension(spark, sf_dir)
    return d.where(F.col("is_new")).select("service_id", "name", "category")


def _expense_values():
    return "VALUES " + ", ".join(f"('{_esc(n)}', '{_esc(c)}', '{_esc(p)}', {s})" for n, c, p, s in vocab.EXPENSE_TYPES)


@query("expense_hierarchy", S.with_cf(f"et(name, category, parent_category, sort_order) AS ({_expense_values()})",
                                      f"""x AS (SELECT {_case('line_item', FD.PRIORITY_EXPENSE)} AS line_item, amount FROM cfl)""",
                                      """g AS (SELECT parent_category, category, SUM(amount) AS amount, MIN(sort_order) AS sort_order,
  GROUPING(parent_category, category) AS gid FROM x JOIN et ON x.line_item = et.name GROUP BY ROLLUP (parent_category, category))""") + """
SELECT parent_category, category, CASE WHEN gid = 3 THEN 'total' WHEN gid = 1 THEN 'parent' ELSE 'category' END AS level,
  CAST(amount AS DOUBLE) AS amount, sort_order FROM g""")
def expense_hierarchy(spark, sf_dir):
    from ..sources.seeds import expense_types
    lines = Warehouse.of(spark, sf_dir).cf_lines.select(FD._map(FD.PRIORITY_EXPENSE, F.col("line_item")).alias("line_item"), "amount")
    return finish(C.expense_hierarchy(lines, expense_types(spark)))


@query("dim_date", """WITH b AS (SELECT CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi FROM lineitem),
d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date_id FROM b)
SELECT date_id, CAST(dayofmonth(date_id) AS INTEGER) AS day_of_month, CAST(isodow(date_id) AS INTEGER) AS day_of_week,
  dayname(date_id) AS day_name, CAST(week(date_id) AS INTEGER) AS week_of_year, CAST(month(date_id) AS INTEGER) AS month_num,
  monthname(date_id) AS month_name, CAST(quarter(date_id) AS INTEGER) AS quarter, CAST(year(date_id) AS INTEGER) AS year,
  isodow(date_id) <= 5 AS is_workday, strftime(date_id, '%Y-%m') AS year_month FROM d""")
def dim_date(spark, sf_dir):
    b = read(spark, sf_dir, "lineitem").agg(F.to_date(F.min("l_shipdate")).alias("lo"), F.to_date(F.max("l_shipdate")).alias("hi"))
    return CAL.calendar_from_bounds(b)


PF = dict(date_from=dt.date(1997, 1, 1), date_to=dt.date(1997, 12, 31), branch_id=3, operation_type="payment", needle="gear")


@query("param_filter", S.with_fact() + f"""SELECT {S.dbl(['invoice_amount', 'transaction_amount'])}, transaction_date, year_month,
  branch_id, patient_hash, is_child, payment_type_id, operation_type, service_name, doctor_id, is_primary_visit FROM fact
WHERE transaction_date >= DATE '{PF['date_from']}' AND transaction_date <= DATE '{PF['date_to']}' AND branch_id = {PF['branch_id']}
  AND operation_type = '{PF['operation_type']}' AND contains(lower(service_name), '{PF['needle']}')""")
def param_filter(spark, sf_dir):
    f = Warehouse.of(spark, sf_dir).fact
    r = FL.param_filter(f, "transaction_date", PF["date_from"], PF["date_to"], contains={"service_name": PF["needle"]},
                        branch_id=PF["branch_id"], operation_type=PF["operation_type"])
    return finish(r)


ETL_CTES = (SRC, TX_EXPECTED, """fact AS (SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS year_month,
  CASE WHEN clinic = 'Unknown clinic' THEN NULL ELSE c_nationkey END AS branch_id, patient_hash,
  CASE WHEN operation_type = '""" + vocab.SOURCE_PAYMENT_LABEL + """' THEN 'payment' ELSE 'refund' END AS operation_type,
  visit_status = '""" + vocab.SOURCE_PRIMARY_LABEL + """' AS is_primary_visit, transaction_amount FROM tx)""",
            """cf AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS year_month, c_nationkey AS branch_id, o_orderpriority AS line_item,
  SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE n_regionkey <> 4 GROUP BY ALL)""", S.DIM_BRANCH, S.REVENUE_ACCRUAL, S._cf_summary_sql(), S.PNL_BODY)


@query("pipeline_monthly_pnl", S.with_(*ETL_CTES) + f"SELECT {S.pnl_select()} FROM pnl")
def pipeline_monthly_pnl(spark, sf_dir):
    """The P&L from landed files alone: transactions, clinic grids, journal, costs and leads loaded, all marts made."""
    from .. import etl
    from ..sources.driver import DRIVER_CF_PATTERNS, DRIVER_SERVICE_DEFAULT, DRIVER_SERVICE_RULES
    from ..streaming.incremental import scratch_dirs
    root = scratch_dirs(spark, "etl")[0]
    paths = {"transactions": "transactions", "clinics_cells": "clinics_cells", "journal": "cf_journal", "costs": "cost_sheet", "leads": "leads_sheet"}
    allowed = read(spark, sf_dir, "nation").where(F.col("n_regionkey") != 4).select("n_name")
    branches = dim_branch(spark, sf_dir)
    aliases = FD.branch_aliases(spark, sf_dir).unionByName(branches.select(F.col("name").alias("alias"), "code"))
    ran = etl.run_all(spark, root, {k: FD.landed(spark, sf_dir, v) for k, v in paths.items()}, aliases, branches, _payment_types(spark),
                      clinics=allowed, patterns=DRIVER_CF_PATTERNS, service_rules=DRIVER_SERVICE_RULES, service_default=DRIVER_SERVICE_DEFAULT)
    if failed := ran.where("error IS NOT NULL").collect():
        raise RuntimeError(f"steps failed: {failed}")
    return finish(spark.read.parquet(f"{root}/marts/monthly_pnl"))
