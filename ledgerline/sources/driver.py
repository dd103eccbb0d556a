"""Star-schema adapter over the driver's tables (``region nation customer
supplier part orders lineitem events``).

Mapping (engine column <- driver column):

* transaction_date <- lineitem.l_shipdate (as DATE); year_month = first of month
* branch <- supplier nation (``s_nationkey``, ``n_name``); legal entity <- ``n_regionkey``
* patient <- orders.o_custkey, pseudonymised from ``c_name``
* operation_type <- ``l_returnflag = 'R'`` is a refund, else a payment
* transaction_amount <- extendedprice x (1 - discount) in DECIMAL(15,2), negative for refunds
* payment_type_id <- leading digit of ``o_orderpriority``
* is_child <- ``c_mktsegment = 'HOUSEHOLD'``; is_primary_visit <- ``l_linestatus = 'O'``
* doctor <- supplier; specialization <- supplier region name
* service <- ``p_name``; unit-cost rows <- one per (``p_name``, ``p_type``)
* monthly cash flow <- orders x customer: month of ``o_orderdate``, customer
  nation, ``line_item = o_orderpriority``, ``amount = o_totalprice``,
  direction ``o_orderstatus = 'P'`` inflow else outflow, group ``c_mktsegment``

Join plan: orders x customer is joined first (it is ~1/4 of lineitem) and
projected to the per-order attributes, so the big lineitem side is shuffled
once on the order key; supplier and part are left to adaptive execution (they
grow with the data, so no unconditional broadcast). Only ``nation``/``region``
(fixed 25/5 rows) carry a broadcast hint.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators._joins import bounded_broadcast

from .. import vocab
from ..functions import patient_hash, first_of_month, classify_by_rules

# Classification rules for the driver's service names (ordered, first hit wins).
DRIVER_SERVICE_RULES = [
    ("red", "Featured"),
    ("ring", "Rings"),
    ("gear", "Gears"),
    ("bolt", "Fasteners"),
    ("rod", "Rods"),
    ("plate", "Plates"),
    ("anvil", "Tools"),
    ("widget", "Gadgets"),
]
DRIVER_SERVICE_DEFAULT = "Other"

# Cash-flow buckets over ``o_orderpriority`` line items. Buckets overlap on
# purpose ('4-NOT SPECIFIED' feeds two; '3-MEDIUM' feeds lab and marketing)
# and the two-letter '%IT%' pattern matches no priority by itself.
DRIVER_CF_PATTERNS = {
    "cash_revenue": ["%urgent%"],
    "materials": ["%high%"],
    "lab": ["%medium%"],
    "payroll_doctors": ["%not%"],
    "payroll_assistants": ["%low%"],
    "rent": ["%specified%"],
    "marketing": ["%medium%", "%5-%"],
    "it_costs": ["%IT%", "%2-%"],
}

MONEY = "decimal(15,2)"


# Tables that grow with the data; the fixed-size ones (nation, region) and
# the supplier dimension are read as they are.
GROWING = {"lineitem", "orders", "customer", "part", "events", "documents", "pages", "conversations"}


def spread(df: DataFrame) -> DataFrame:
    """Widen a scan that is narrower than the cluster.

    A table stored as one file with one row group scans as a single task, so
    all row-level work before the first shuffle would run on one core. When
    the scan has fewer partitions than ``defaultParallelism`` it is spread
    round-robin; a scan that is already wide (the large-data case: many files
    and row groups) is left untouched, so no extra shuffle is added at scale.
    The partition count comes from planning the scan, no job is run."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        narrow = df.rdd.getNumPartitions() < target
    except Exception:  # no RDD API (e.g. a Connect session): leave the scan as is
        return df
    return df.repartition(target) if narrow else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in GROWING else df


def order_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order attributes (orders x customer), one row per order."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority",
                                             "o_totalprice", "o_orderdate", "o_orderstatus")
    c = read(spark, sf_dir, "customer").select(
        F.col("c_custkey"), patient_hash("c_name").alias("patient_hash"),
        (F.col("c_mktsegment") == F.lit("HOUSEHOLD")).alias("is_child"),
        "c_nationkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "left")


def fact_transactions(spark: SparkSession, sf_dir: str, services: bool = True) -> DataFrame:
    """The conformed fact; without ``services`` it has no ``service_name`` and lines don't meet ``part``."""
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus", "l_shipdate")
    oa = order_attributes(spark, sf_dir).select(
        "o_orderkey", "patient_hash", "is_child",
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("payment_type_id"),
        F.col("o_totalprice").cast(MONEY).alias("invoice_amount"))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("branch_id"))
    x = li
    if services:  # first: where parts are too many to broadcast, lines move by part before they carry their order
        p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("service_name"))
        x = x.join(p, li.l_partkey == p.p_partkey, "left")
    x = (x.join(oa, li.l_orderkey == oa.o_orderkey, "inner")
         .join(s, li.l_suppkey == s.s_suppkey, "left"))
    amount = (F.col("l_extendedprice").cast(MONEY)
              * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY)
    refund = F.col("l_returnflag") == F.lit("R")
    d = F.to_date("l_shipdate")
    return x.select(
        d.alias("transaction_date"),
        first_of_month(d).alias("year_month"),
        "branch_id", "patient_hash", "is_child", "payment_type_id",
        F.when(refund, F.lit(vocab.REFUND)).otherwise(F.lit(vocab.PAYMENT)).alias("operation_type"),
        "invoice_amount", *(["service_name"] if services else []),
        F.col("l_suppkey").cast("int").alias("doctor_id"),
        (F.col("l_linestatus") == F.lit("O")).alias("is_primary_visit"),
        F.when(refund, -amount).otherwise(amount).alias("transaction_amount"),
    )


def cf_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly cash-flow lines (the P&L cash half and the cash-flow report input)."""
    oa = order_attributes(spark, sf_dir)
    return oa.select(
        first_of_month("o_orderdate").alias("year_month"),
        F.col("c_nationkey").alias("branch_id"),
        F.col("o_orderpriority").alias("line_item"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.when(F.col("o_orderstatus") == F.lit("P"), F.lit("inflow")).otherwise(F.lit("outflow")).alias("direction"),
        F.col("c_mktsegment").alias("cf_group"),
    )


def dim_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    return bounded_broadcast(n.select(
        F.col("n_nationkey").alias("branch_id"), F.col("n_name").alias("name"),
        F.lower("n_name").alias("code"), F.col("n_name").alias("display_name"),
        F.col("n_regionkey").alias("legal_entity_id")))


def dim_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    n = bounded_broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    r = bounded_broadcast(read(spark, sf_dir, "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey, "left")
            .join(r, F.col("n_regionkey") == r.r_regionkey, "left")
            .select(F.col("s_suppkey").cast("int").alias("doctor_id"),
                    F.col("s_name").alias("full_name"),
                    F.col("r_name").alias("specialization"),
                    F.col("s_nationkey").alias("primary_branch_id")))


def dim_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return (p.groupBy(F.col("p_name").alias("name"))
            .agg(F.min("p_partkey").cast("int").alias("service_id"))
            .withColumn("category", classify_by_rules("name", DRIVER_SERVICE_RULES, DRIVER_SERVICE_DEFAULT))
            .select("service_id", "name", "category"))


def cost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-cost rows keyed by service *name*; one per (p_name, p_type), so each
    name has several rows (the fan-out case of the service-economics join)."""
    p = read(spark, sf_dir, "part")
    g = p.groupBy(F.col("p_name").alias("service_name"), F.col("p_type").alias("service_code")).agg(
        F.max("p_retailprice").cast("decimal(10,2)").alias("price"),
        (F.min("p_size") * F.lit(10)).cast("decimal(10,2)").alias("material_cost"),
        (F.max("p_size") * F.lit(20)).cast("decimal(10,2)").alias("doctor_pay"))
    total = F.col("material_cost") + F.col("doctor_pay")
    return g.select(
        "service_code", "service_name", "price", "material_cost", "doctor_pay",
        total.alias("total_cost"), (F.col("price") - total).alias("margin_rub"),
        F.try_divide(F.col("material_cost").cast("double"), F.col("price").cast("double")).alias("material_pct"),
        F.try_divide((F.col("price") - total).cast("double"), F.col("price").cast("double")).alias("margin_pct"))


class Warehouse:
    """The conformed star schema over one driver directory, built once per
    session and shared by every report.

    ``ledgerline.warehouse.mode`` (session setting) chooses how it is kept:

    * ``persist`` (default): ``persist(MEMORY_AND_DISK)``; partitions lost with
      an executor are recomputed from lineage.
    * ``table``: the fact and the monthly cash flow are written once to the
      shared folder named by ``spark.checkpoint.dir`` (Parquet, partitioned by
      ``year_month``) and read back — lineage is cut, a lost executor costs a
      re-read of its files, and month predicates prune partitions.
    """

    _memo: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}
        self.mode = spark.conf.get("ledgerline.warehouse.mode", "persist")

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Warehouse":
        try:
            app = spark.sparkContext.applicationId
        except Exception:
            app = spark.conf.get("spark.app.id", "")
        key = (app, id(spark), sf_dir.rstrip("/"), spark.conf.get("ledgerline.warehouse.mode", "persist"))
        w = cls._memo.get(key)
        if w is None:
            w = cls._memo[key] = cls(spark, sf_dir)
        return w

    def _get(self, name, build, keep=True, table=False):
        if name not in self._frames:
            df = build()
            if keep and table and self.mode == "table":
                df = self._write(name, df)
            elif keep:
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._frames[name] = df
        return self._frames[name]

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        import hashlib
        import os
        from ..session import ensure_checkpoint_dir
        tag = hashlib.sha1(self.sf_dir.rstrip("/").encode()).hexdigest()[:12]
        try:
            app = self.spark.sparkContext.applicationId
        except Exception:
            app = self.spark.conf.get("spark.app.id", "app")
        # per application: concurrent sessions never overwrite each other's tables
        path = os.path.join(ensure_checkpoint_dir(self.spark), "warehouse", app, tag, name)
        # REBALANCE: files grouped by month, but AQE splits a hot month across tasks
        (df.hint("rebalance", "year_month").write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy("year_month").parquet(path))
        return self.spark.read.parquet(path)

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    @property
    def fact(self) -> DataFrame:
        return self._get("fact", lambda: fact_transactions(self.spark, self.sf_dir), table=True)

    @property
    def cf(self) -> DataFrame:
        return self._get("cf", lambda: cf_monthly(self.spark, self.sf_dir), table=True)

    @property
    def branches(self) -> DataFrame:
        return dim_branch(self.spark, self.sf_dir)

    @property
    def cf_lines(self) -> DataFrame:
        """Cash-flow report input: monthly lines with branch name."""
        names = self.branches.select("branch_id", F.col("display_name").alias("branch_name"))
        return self.cf.join(names, "branch_id", "left")

    @property
    def doctors(self) -> DataFrame:
        return self._get("doctors", lambda: dim_doctor(self.spark, self.sf_dir), keep=False)

    @property
    def services(self) -> DataFrame:
        return self._get("services", lambda: dim_service(self.spark, self.sf_dir), keep=False)

    @property
    def costs(self) -> DataFrame:
        return self._get("costs", lambda: cost_rows(self.spark, self.sf_dir), keep=False)

    @property
    def pnl(self) -> DataFrame:
        from ..operators.marts import monthly_pnl
        # The P&L knows no services: until the whole fact is kept for another report, it reads one without them, which isn't kept.
        fact = lambda: self.fact if "fact" in self._frames else fact_transactions(self.spark, self.sf_dir, services=False)
        return self._get("pnl", lambda: monthly_pnl(fact(), self.cf, self.branches, DRIVER_CF_PATTERNS))

    @property
    def doctor_kpi(self) -> DataFrame:
        from ..operators.marts import doctor_kpi
        return self._get("doctor_kpi", lambda: doctor_kpi(self.fact, self.doctors, self.branches))

    @property
    def branch_comparison(self) -> DataFrame:
        from ..operators.marts import branch_comparison
        return self._get("branch_comparison", lambda: branch_comparison(self.fact, self.branches))

    @property
    def patient_base(self) -> DataFrame:
        from ..operators.statements import patient_base
        return self._get("patient_base", lambda: patient_base(self.fact))

    @property
    def service_economics(self) -> DataFrame:
        from ..operators.marts import service_economics
        return self._get("service_economics",
                         lambda: service_economics(self.fact, self.costs, self.branches, self.services))
