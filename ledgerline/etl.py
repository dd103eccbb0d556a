"""End-to-end batch flows (the source's ``transactions`` and ``refresh``
commands, SURVEY §3.1-3.2), composed from the operators.

Layout under ``root``: ``raw/`` (typed extracts, never the clear patient
name), ``dwh/`` (dimensions, month-partitioned fact), ``marts/``. A
dimension is rewritten in place after its new version has been cut from its
lineage with a reliable ``checkpoint()`` (into the shared
``spark.checkpoint.dir``), because a job cannot overwrite the path it reads.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import vocab
from .operators import conform as C
from .operators.marts import branch_patients, monthly_pnl, doctor_kpi, branch_comparison, service_economics
from .operators.quality import alerts
from .pipeline import run_steps
from .session import ensure_checkpoint_dir
from .sinks import append_frames, write_table
from .sources import files as FI, grid as G

DIM_DOCTOR_DDL = "doctor_id int, full_name string"
DIM_SERVICE_DDL = "service_id int, name string, category string"


def _read_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # first run: the table does not exist yet
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        return spark.createDataFrame([], ddl)


def _upsert(spark, incoming: DataFrame, path: str, ddl: str, key: str, id_col: str, dim_key: str,
            rules=None, default=None) -> int:
    ensure_checkpoint_dir(spark)
    dim = _read_or_empty(spark, path, ddl)
    new = C.upsert_dimension(incoming, dim, key, id_col, dim_key=dim_key, rules=rules, default=default)
    frozen = new.checkpoint()          # reliable checkpoint: cut lineage before overwriting the source path
    added = frozen.where(F.col("is_new")).count()
    write_table(frozen.drop("is_new"), path, "overwrite")
    return added


def transactions(spark: SparkSession, raw_path: str, root: str, aliases: DataFrame, dim_branch: DataFrame,
                 payment_types: DataFrame, service_rules=vocab.SERVICE_CATEGORY_RULES,
                 service_default: str = vocab.SERVICE_CATEGORY_DEFAULT) -> dict:
    """File -> raw -> dimensions -> fact. Returns row counts per step."""
    raw = FI.read_flat(spark, raw_path, list(vocab.TRANSACTION_COLUMNS),
                       ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    typed = FI.transactions_typed(raw)
    good, rejects = FI.split_rejects(typed)
    out = {"raw": write_table(good, os.path.join(root, "raw", "transactions")),
           "rejected": write_table(rejects, os.path.join(root, "raw", "transactions_rejected"))}
    good = spark.read.parquet(os.path.join(root, "raw", "transactions"))
    out["new_doctors"] = _upsert(spark, good.select("doctor_name"), os.path.join(root, "dwh", "dim_doctor"),
                                 DIM_DOCTOR_DDL, "doctor_name", "doctor_id", "full_name")
    out["new_services"] = _upsert(spark, good.select("service_items"), os.path.join(root, "dwh", "dim_service"),
                                  DIM_SERVICE_DDL, "service_items", "service_id", "name",
                                  rules=service_rules, default=service_default)
    doctors = spark.read.parquet(os.path.join(root, "dwh", "dim_doctor"))
    fact = C.conform_fact(good, aliases, dim_branch, payment_types, doctors)
    out["fact"] = write_table(fact, os.path.join(root, "dwh", "fact_transactions"), "overwrite",
                              partition_by="year_month")
    return out


def cash_flow(spark: SparkSession, root: str, dim_branch: DataFrame, aliases: DataFrame, svod_cells: str | None = None,
              entity_map: DataFrame | None = None, clinics_cells: str | None = None, clinics=None) -> int:
    """Grids -> monthly cash-flow fact: consolidated rows by legal entity (``entity_map``: short_name, legal_entity_id),
    clinic rows by branch (``clinics``: the names that count). Either grid may be missing, not both."""
    parts = []
    if svod_cells:
        parts.append(C.cf_monthly_conform(G.grid_unpivot_svod(spark.read.parquet(svod_cells)), entity_map))
    if clinics_cells:
        grid = G.grid_unpivot_clinics(spark.read.parquet(clinics_cells), clinics)
        parts.append(C.cf_clinics_conform(grid, aliases, dim_branch))
    if not parts:
        raise FileNotFoundError("no grid")
    return write_table(append_frames(*parts), os.path.join(root, "dwh", "fact_cf_monthly"), partition_by="year_month")


def journal(spark: SparkSession, root: str, path: str, dim_branch: DataFrame, aliases: DataFrame) -> int:
    """Cash-flow journal -> entries with branch ids."""
    raw = FI.read_flat(spark, path, list(vocab.CF_ENTRY_COLUMNS), ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    entries = FI.ingest_cf_entries(raw, source_file=os.path.basename(path.rstrip("/")))
    return write_table(C.conform_cf_entries(entries, aliases, dim_branch), os.path.join(root, "dwh", "fact_cf_entries"))


def costs(spark: SparkSession, root: str, path: str) -> int:
    """Unit-cost sheet -> cost rows."""
    raw = FI.read_flat(spark, path, list(vocab.COST_COLUMNS), ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return write_table(FI.ingest_cost_structure(raw), os.path.join(root, "dwh", "fact_cost_structure"))


def leads(spark: SparkSession, root: str, path: str) -> int:
    """Lead sheet (a row per type and year, a column per month) -> monthly leads."""
    raw = FI.read_flat(spark, path, [vocab.LEAD_LABEL_COLUMN, "year", *vocab.MONTH_NAMES], ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    long = FI.unpivot_leads(raw, year="year").withColumn("year_month", F.make_date("year", "month", F.lit(1)))
    return write_table(long, os.path.join(root, "dwh", "fact_leads"))


def run_all(spark: SparkSession, root: str, sources: dict, aliases: DataFrame, dim_branch: DataFrame, payment_types: DataFrame,
            entity_map: DataFrame | None = None, clinics=None, patterns: dict | None = None,
            service_rules=vocab.SERVICE_CATEGORY_RULES, service_default: str = vocab.SERVICE_CATEGORY_DEFAULT) -> DataFrame:
    """SNK-5: every source that is there, then all marts: (step, rows, error, seconds).

    ``sources`` may hold paths under ``transactions``, ``svod_cells``,
    ``clinics_cells``, ``journal``, ``costs`` and ``leads``. A source that isn't
    named or can't be found is skipped, one that fails is reported, and the
    marts are made from what has been loaded, now or before.
    """
    at = sources.get
    steps = {}
    if at("transactions"):
        steps["transactions"] = lambda: transactions(spark, at("transactions"), root, aliases, dim_branch, payment_types, service_rules, service_default)["fact"]
    if at("svod_cells") or at("clinics_cells"):
        steps["cash_flow"] = lambda: cash_flow(spark, root, dim_branch, aliases, at("svod_cells"), entity_map, at("clinics_cells"), clinics)
    for name, load in (("journal", lambda: journal(spark, root, at("journal"), dim_branch, aliases)),
                       ("costs", lambda: costs(spark, root, at("costs"))), ("leads", lambda: leads(spark, root, at("leads")))):
        if at(name):
            steps[name] = load
    loaded = run_steps(spark, steps)
    made = [(f"mart {name}", rows if isinstance(rows, int) else None, None if isinstance(rows, int) else rows, None)
            for name, rows in refresh(spark, root, dim_branch, patterns=patterns).items()]
    return loaded.unionByName(spark.createDataFrame(made, loaded.schema))


def refresh(spark: SparkSession, root: str, dim_branch: DataFrame, cf_monthly: DataFrame | None = None,
            patterns: dict | None = None) -> dict:
    """Fact -> marts and alerts (one job each; a failure in one does not stop the others). A mart is replaced as a whole,
    so months that the fact no longer has are gone from it, whatever the session's overwrite mode. Cash flow and costs
    are read where they have been loaded; without costs there is no service mart."""
    at = lambda *x: os.path.join(root, *x)
    fact = spark.read.parquet(at("dwh", "fact_transactions"))
    doctors = spark.read.parquet(at("dwh", "dim_doctor"))
    if "specialization" not in doctors.columns:
        doctors = doctors.withColumn("specialization", F.lit(None).cast("string"))
    if cf_monthly is None:
        cf_monthly = _read_or_empty(spark, at("dwh", "fact_cf_monthly"), "year_month date, branch_id int, line_item string, amount decimal(15,2)")
    cost_rows = _read_or_empty(spark, at("dwh", "fact_cost_structure"), "service_name string")
    patients = branch_patients(fact).persist()  # a row per month and branch, counted once for two marts
    marts = {
        "monthly_pnl": lambda: monthly_pnl(fact, cf_monthly, dim_branch, patterns, patients=patients),
        "doctor_kpi": lambda: doctor_kpi(fact, doctors, dim_branch),
        "branch_comparison": lambda: branch_comparison(fact, dim_branch, patients=patients),
        "alerts": lambda: alerts(spark.read.parquet(at("marts", "monthly_pnl"))),
    }
    if "material_cost" in cost_rows.columns:
        services = spark.read.parquet(at("dwh", "dim_service"))
        marts["service_economics"] = lambda: service_economics(fact, cost_rows, dim_branch, services)
    out = {}
    for name, build in marts.items():
        try:
            mart = build()
            by_month = "year_month" in mart.columns
            out[name] = write_table(mart.hint("rebalance", "year_month") if by_month and name != "doctor_kpi" else mart, at("marts", name), "overwrite", "year_month" if by_month else None)
        except Exception as e:  # isolate, as a failed refresh must not block the rest
            out[name] = f"error: {str(e).splitlines()[0][:200]}"
    patients.unpersist()
    return out
