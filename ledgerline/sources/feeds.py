"""Landing-format inputs derived from the driver tables.

The ingest operators take files, grids and JSON pages; to run them over the
driver's data at full size (and check them against SQL), these builders
render the driver tables into exactly those shapes: text columns with source
headers (some values deliberately malformed, padded or blank), long cell
tables, JSON text. Every builder is a DataFrame job over whole tables; any
``collect_list`` is over a group bounded by construction (order lines, 25
nations, 25 brands, a page of 1,000 records).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators._joins import bounded_broadcast, estimated_bytes

from .. import vocab, schemas as SC
from .driver import read, DRIVER_SERVICE_RULES, DRIVER_SERVICE_DEFAULT
from ..functions import patient_hash, classify_by_rules

MONEY = "decimal(15,2)"
PAGE_SIZE = 1000
STALE_PAGE = 1_000_000_000

# Driver priority -> payment-type name (must exist in vocab.PAYMENT_TYPES; one padded).
PRIORITY_PAYMENT = {"1-URGENT": "Карта", "2-HIGH": "Наличные б/ч", "3-MEDIUM": "Бонусы (карта АЕ)",
                    "4-NOT SPECIFIED": "Прочие", "5-LOW": " Карта "}
# Driver priority -> lead sheet row label (two kept, one total row, one unknown).
PRIORITY_LEAD = {"1-URGENT": "Первичные", "2-HIGH": "Вторичные", "3-MEDIUM": "Итого", "4-NOT SPECIFIED": "Прочее"}
# Driver priority -> expense type name (for the expense hierarchy).
PRIORITY_EXPENSE = {"1-URGENT": "Выручка наличными", "2-HIGH": "Расходные материалы", "3-MEDIUM": "Лаборатория",
                    "4-NOT SPECIFIED": "Аренда офиса", "5-LOW": "Маркетинг"}


def _map(d: dict, c):
    e = None
    for k, v in d.items():
        e = F.when(c == k, F.lit(v)) if e is None else e.when(c == k, F.lit(v))
    return e


def clinic_variant(name, priority, status):
    """Branch text as different source systems spell it."""
    return (F.when((priority == "5-LOW") & (status == "P"), F.lit("Unknown clinic"))
            .when(priority == "1-URGENT", F.concat(F.lit("("), name, F.lit(")")))
            .when(priority == "2-HIGH", F.upper(name))
            .when(priority == "3-MEDIUM", F.concat(F.lit("  "), name, F.lit(" ")))
            .otherwise(name))


def branch_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alias -> code for every nation: plain, bracketed, upper case."""
    n = read(spark, sf_dir, "nation").select("n_name", F.lower("n_name").alias("code"))
    return (n.select(F.col("n_name").alias("alias"), "code")
            .unionByName(n.select(F.concat(F.lit("("), "n_name", F.lit(")")).alias("alias"), "code"))
            .unionByName(n.select(F.upper("n_name").alias("alias"), "code")).distinct())


def _order_frame(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer")
    n = bounded_broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return (o.join(c, o.o_custkey == c.c_custkey, "inner")
            .join(n, F.col("c_nationkey") == n.n_nationkey, "left"))


def transactions_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1 input: one text row per order line with the source headers."""
    li = read(spark, sf_dir, "lineitem")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    amt = (F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY)
    li = li.select("l_orderkey", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("ship"), (F.col("l_quantity") >= 50).alias("no_date"),
                   (F.col("l_discount") == 0.1).alias("no_amount"), (F.col("l_returnflag") == "R").alias("refund"),
                   (F.col("l_linestatus") == "O").alias("primary"), amt.alias("amt"))
    # parts first: where they are too many to broadcast, lines move by part before they carry their order
    x = (li.join(p, li.l_partkey == p.p_partkey, "left")
         .join(_order_frame(spark, sf_dir), li.l_orderkey == F.col("o_orderkey"), "inner")
         .join(s, li.l_suppkey == s.s_suppkey, "left"))
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    signed = F.when(F.col("refund"), -F.col("amt")).otherwise(F.col("amt"))
    H = {v: k for k, v in vocab.TRANSACTION_COLUMNS.items()}
    return x.select(
        F.when(F.col("no_date"), F.lit("n/a"))
        .when(pr == "2-HIGH", F.date_format("ship", "yyyy-MM-dd"))
        .otherwise(F.date_format("ship", "dd.MM.yyyy")).alias(H["transaction_date"]),
        clinic_variant(F.col("n_name"), pr, st).alias(H["clinic"]),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("\t"), "c_name", F.lit(" ")))
        .when((F.col("c_mktsegment") == "BUILDING") & (st == "P"), F.lit("   "))
        .otherwise(F.col("c_name")).alias(H["patient_name"]),
        F.lit(None).cast("string").alias(H["patient_age"]),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(vocab.SOURCE_CHILD_LABEL)).otherwise(F.lit("Взрослый"))
        .alias(H["age_group"]),
        _map(PRIORITY_PAYMENT, pr).alias(H["payment_type"]),
        F.when(F.col("refund"), F.lit(vocab.SOURCE_REFUND_LABEL))
        .otherwise(F.lit(vocab.SOURCE_PAYMENT_LABEL)).alias(H["operation_type"]),
        F.col("n_name").alias(H["invoice_clinic"]),
        F.col("o_totalprice").cast(MONEY).cast("string").alias(H["invoice_amount"]),
        F.lit("0").alias(H["invoice_debt"]),
        st.alias(H["invoice_status"]),
        F.when(st == "O", F.concat(F.lit("  "), "p_name")).otherwise(F.col("p_name")).alias(H["service_items"]),
        F.concat_ws(", ", F.date_format("ship", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias(H["visit_dates"]),
        F.lit("Осмотр").alias(H["visit_reasons"]),
        F.when(pr == "4-NOT SPECIFIED", F.concat(F.lit(" "), "s_name", F.lit(" "))).otherwise(F.col("s_name"))
        .alias(H["doctor_name"]),
        F.when(F.col("primary"), F.lit(vocab.SOURCE_PRIMARY_LABEL)).otherwise(F.lit("Повторный"))
        .alias(H["visit_status"]),
        F.when(F.col("no_amount"), F.lit("x")).otherwise(signed.cast("string")).alias(H["transaction_amount"]),
    )


def cf_journal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2 input: a journal row per order; day-first dates; some amounts blank."""
    x = _order_frame(spark, sf_dir)
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    H = {v: k for k, v in vocab.CF_ENTRY_COLUMNS.items()}
    return x.select(
        F.lit("operating").alias(H["entry_type"]),
        F.when(st == "P", "inflow").otherwise("outflow").alias(H["direction"]),
        F.month("o_orderdate").cast("string").alias(H["month_num"]),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias(H["entry_date"]),
        F.concat(F.lit("DOC-"), F.col("o_orderkey").cast("string")).alias(H["document"]),
        pr.alias(H["description"]), F.lit("51").alias(H["debit_account"]), F.lit("62").alias(H["credit_account"]),
        F.when((st == "P") & (pr == "5-LOW"), F.lit("")).otherwise(F.col("o_totalprice").cast(MONEY).cast("string"))
        .alias(H["amount"]),
        F.col("c_name").alias(H["counterparty"]),
        clinic_variant(F.col("n_name"), pr, F.lit("F")).alias(H["branch_uu"]),
        F.col("c_mktsegment").alias(H["account_uu"]), pr.alias(H["expense_category"]))


def cost_sheet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5 input: one unit-cost row per part (some without name or price)."""
    p = read(spark, sf_dir, "part")
    H = {v: k for k, v in vocab.COST_COLUMNS.items()}
    sz = F.col("p_size")
    return p.select(
        F.col("p_partkey").cast("string").alias(H["service_code"]),
        F.when(sz == 1, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias(H["service_name"]),
        F.when(sz == 50, F.lit("0")).otherwise(F.col("p_retailprice").cast("decimal(10,2)").cast("string")).alias(H["price"]),
        (sz * 10).cast("string").alias(H["material_cost"]), (sz * 20).cast("string").alias(H["doctor_pay"]),
        F.lit("0").alias(H["assistant_pay"]), F.lit("n/a").alias(H["taxes"]), (sz * 30).cast("string").alias(H["total_cost"]))


def leads_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6 input: orders counted per month, one wide row per (label, year)."""
    o = read(spark, sf_dir, "orders")
    lab = _map(PRIORITY_LEAD, F.col("o_orderpriority"))
    g = o.groupBy(lab.alias(vocab.LEAD_LABEL_COLUMN), F.year("o_orderdate").alias("year"),
                  F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    w = g.groupBy(vocab.LEAD_LABEL_COLUMN, "year").pivot("m", list(range(1, 13))).agg(F.first("n"))
    return w.select(vocab.LEAD_LABEL_COLUMN, "year",
                    *[F.col(str(i + 1)).cast("string").alias(m) for i, m in enumerate(vocab.MONTH_NAMES)])


def weekly_sources_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7 input: events per type and ISO week, one column per week."""
    e = read(spark, sf_dir, "events")
    ws = F.to_date(F.date_trunc("week", "ts"))
    hdr = F.concat_ws("/", F.date_format(ws, "yyyy-MM-dd"), F.date_format(F.date_add(ws, 6), "yyyy-MM-dd"))
    g = e.groupBy(F.col("event_type").alias("source"), hdr.alias("week")).agg(F.count(F.lit(1)).cast("string").alias("n"))
    return g.groupBy("source").pivot("week").agg(F.first("n"))


def svod_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3 input: consolidated grid cells. Columns are (month, region);
    rows are order priorities; one row holds text, one cell block is zero."""
    x = _order_frame(spark, sf_dir).withColumn("ym_y", F.year("o_orderdate")).withColumn("ym_m", F.month("o_orderdate"))
    r = bounded_broadcast(read(spark, sf_dir, "region"))
    x = x.join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    col = (F.lit(2) + ((F.col("ym_y") - F.lit(1990)) * F.lit(12) + F.col("ym_m") - F.lit(1)) * F.lit(5)
           + F.col("r_regionkey")).cast("int")
    row = (F.lit(5) + F.substring("o_orderpriority", 1, 1).cast("int")).cast("int")
    g = x.groupBy("ym_y", "ym_m", "r_regionkey", "r_name", "o_orderpriority").agg(
        F.sum(F.col("o_totalprice").cast(MONEY)).alias("total"))
    g = g.withColumn("col_idx", col).withColumn("row_idx", row)
    tag = [F.lit("cf_svod.xlsx").alias("source_file"), F.lit("CF_СВОД").alias("sheet")]
    heads = g.select("col_idx", "ym_y", "ym_m", "r_name").distinct()
    h0 = heads.select(*tag, F.lit(0).alias("row_idx"), "col_idx",
                      F.concat_ws("-", F.col("ym_y").cast("string"), F.col("ym_m").cast("string")).alias("value"))
    h1 = heads.select(*tag, F.lit(1).alias("row_idx"), "col_idx", F.col("r_name").alias("value"))
    labels = g.select("row_idx", "o_orderpriority").distinct().select(
        *tag, "row_idx", F.lit(1).alias("col_idx"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("value"))
    title = spark.range(1).select(*tag, F.lit(5).alias("row_idx"), F.lit(1).alias("col_idx"), F.lit("Статья").alias("value"))
    pr = F.col("o_orderpriority")
    val = (F.when(pr == "4-NOT SPECIFIED", F.lit("n/a"))
           .when((pr == "3-MEDIUM") & (F.col("r_regionkey") == 0), F.lit("0"))
           .otherwise(F.col("total").cast("string")))
    data = g.select(*tag, "row_idx", "col_idx", val.alias("value"))
    return h0.unionByName(h1).unionByName(labels).unionByName(title).unionByName(data)


def clinics_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4 input: one grid per month: nations across row 1, priorities down."""
    x = _order_frame(spark, sf_dir)
    f = F.concat(F.lit("cf_clinics_"), F.date_format("o_orderdate", "yyyy_MM"), F.lit(".xlsx"))
    g = x.groupBy(f.alias("source_file"), "n_nationkey", "n_name", "o_orderpriority").agg(
        F.sum(F.col("o_totalprice").cast(MONEY)).alias("total"))
    g = g.withColumn("sheet", F.lit("CF clinics")).withColumn("col_idx", (F.col("n_nationkey") + 2).cast("int")) \
        .withColumn("row_idx", (F.substring("o_orderpriority", 1, 1).cast("int") + 2).cast("int"))
    names = g.select("source_file", "sheet", F.lit(1).alias("row_idx"), "col_idx",
                     F.concat(F.lit(" "), "n_name").alias("value")).distinct()
    labels = g.select("source_file", "sheet", "row_idx", F.lit(1).alias("col_idx"),
                      F.col("o_orderpriority").alias("value")).distinct()
    data = g.select("source_file", "sheet", "row_idx", "col_idx", F.col("total").cast("string").alias("value"))
    return names.unionByName(labels).unionByName(data)


# ----------------------------------------------------------------- JSON ----
LINE_BYTES = 16 * 1024 * 1024  # of stored lineitem a task: about a million lines


def _by_order(lines: DataFrame, stored: int | None) -> DataFrame:
    """Lines moved to their order. A task sorts its lines, their lists and its
    orders; where the session's partitions are too few for ``stored`` bytes, more
    are made: a task that gets more lines the more there are spills in the end."""
    tasks = -(-(stored or 0) // LINE_BYTES)
    least = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(tasks, "l_orderkey") if tasks > least else lines.repartition("l_orderkey")


def _services_by_order(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    ext = F.col("l_extendedprice")
    # lines move once, as plain columns; partial arrays of structs would hold each string twice
    x = _by_order(li.join(p, li.l_partkey == p.p_partkey, "left"), estimated_bytes(li))
    return x.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("l_partkey").cast("int").alias("service_id"), F.col("p_type").alias("code"),
            F.col("p_name").alias("name"), F.col("p_type").alias("category"),
            F.col("l_quantity").cast("int").alias("quantity"), ext.cast("decimal(10,2)").alias("price"),
            F.col("l_discount").cast("decimal(10,2)").alias("discount"),
            (ext.cast(MONEY) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY).alias("total"),
        ))).alias("services"),
        F.min("l_suppkey").alias("supp"),
        F.sum(ext.cast(MONEY)).alias("subtotal"),
        F.sum((ext.cast(MONEY) * F.col("l_discount").cast("decimal(4,2)")).cast(MONEY)).alias("discount_total"),
        F.array_sort(F.collect_list(F.struct(
            F.col("l_partkey").cast("int").alias("service_id"), F.col("p_name").alias("service_name"),
            F.col("l_quantity").cast("int").alias("quantity"), ext.cast("decimal(10,2)").alias("unit_price"),
            (F.col("l_discount") * 100).cast("decimal(5,2)").alias("discount_percent"),
            (ext.cast(MONEY) * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(10,2)").alias("discount_amount"),
            (ext.cast(MONEY) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY).alias("total"),
        ))).alias("items"))


def _age_group():
    return F.when(F.col("c_mktsegment") == "HOUSEHOLD", "child").otherwise("adult")


def transaction_record(x: DataFrame, with_services: bool = True):
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    amount = F.col("o_totalprice").cast(MONEY)
    return F.struct(
        F.col("o_orderkey").alias("transaction_id"), F.to_date("o_orderdate").alias("transaction_date"),
        F.col("o_orderdate").alias("transaction_datetime"),
        F.struct(F.col("c_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("code")).alias("branch"),
        F.struct(F.col("patient_hash").alias("id"), F.lit(None).cast("int").alias("age"), _age_group().alias("age_group")).alias("patient"),
        F.struct(F.substring(pr, 1, 1).alias("code"), pr.alias("name")).alias("payment_type"),
        F.when(st == "P", "refund").otherwise("payment").alias("operation_type"),
        F.struct(F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("id"),
                 F.col("c_nationkey").alias("branch_id"), amount.alias("total_amount"),
                 F.when(st == "O", amount).otherwise(F.lit(0).cast(MONEY)).alias("debt"), st.alias("status"),
                 F.lit(None).cast(MONEY).alias("discount_amount"), F.lit(None).cast("decimal(5,2)").alias("discount_percent")
                 ).alias("invoice"),
        (F.col("services") if with_services else F.lit(None).cast(SC.TRANSACTION["services"].dataType)).alias("services"),
        (F.col("doctor") if with_services else F.lit(None).cast(SC.TRANSACTION["doctor"].dataType)).alias("doctor"),
        F.struct(F.to_date("o_orderdate").alias("date"),
                 F.when(pr == "1-URGENT", "primary").otherwise("repeat").alias("type"),
                 F.lit(None).cast("string").alias("reason")).alias("visit"),
        amount.alias("amount"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


def _orders_with_patient(spark, sf_dir):
    x = _order_frame(spark, sf_dir)
    return x.withColumn("patient_hash", patient_hash("c_name"))


def transaction_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-8 input: one JSON transaction per order with its services array; the doctor is the first supplier."""
    x = _orders_with_patient(spark, sf_dir)
    sv = _services_by_order(spark, sf_dir).select("l_orderkey", "services", "supp")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("doctor_name"), F.col("s_nationkey").alias("home"))
    n = bounded_broadcast(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("home"), F.col("n_regionkey").alias("region")))
    r = bounded_broadcast(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("spec")))
    doctors = s.join(n, "home", "left").join(r, "region", "left").select("s_suppkey", F.struct(
        F.col("s_suppkey").cast("int").alias("id"), F.col("doctor_name").alias("name"), F.col("spec").alias("specialization")).alias("doctor"))
    x = x.join(sv, x.o_orderkey == sv.l_orderkey, "inner").join(doctors, F.col("supp") == F.col("s_suppkey"), "left")
    return x.select(F.to_json(transaction_record(x)).alias("json"))


def doctor_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10 input: suppliers as doctors; specialisations = part types they
    supplied, branches = customer nations they served (both <= bounded sets,
    pre-aggregated before collecting)."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = bounded_broadcast(read(spark, sf_dir, "nation"))
    types = (li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey", "p_type").agg(F.count(F.lit(1)).alias("_n"))
             .groupBy("l_suppkey").agg(F.array_sort(F.collect_list("p_type")).alias("specs")))
    served = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
              .groupBy(F.col("l_suppkey").alias("sk"), "c_nationkey").agg(F.count(F.lit(1)).alias("_n"))
              .join(n, F.col("c_nationkey") == n.n_nationkey)
              .groupBy("sk").agg(F.array_sort(F.collect_list(F.struct(F.col("c_nationkey").alias("id"),
                                                                         F.col("n_name").alias("name")))).alias("branches")))
    s = read(spark, sf_dir, "supplier")
    r = bounded_broadcast(read(spark, sf_dir, "region"))
    x = (s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
         .join(types, s.s_suppkey == types.l_suppkey, "left").join(served, s.s_suppkey == served.sk, "left"))
    rec = F.struct(
        F.col("s_suppkey").cast("int").alias("doctor_id"), F.col("s_name").alias("full_name"),
        F.concat(F.lit("S"), F.substring("s_name", 9, 20)).alias("short_name"), F.col("r_name").alias("specialization"),
        F.col("specs").alias("additional_specializations"),
        F.struct(F.col("s_nationkey").alias("id"), F.col("n_name").alias("name")).alias("primary_branch"),
        F.col("branches").alias("branches"), (F.col("s_acctbal") > 0).alias("is_active"),
        F.lit(None).cast("date").alias("hire_date"), F.lit(None).cast("timestamp").alias("updated_at"))
    return x.select(F.to_json(rec).alias("json"))


def branch_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9 input: nations as branches, with opening hours (a NULL day)."""
    n = read(spark, sf_dir, "nation")
    cnt = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).cast("int").alias("k"))
    x = n.join(cnt, n.n_nationkey == cnt.s_nationkey, "left")
    hours = F.create_map(F.lit("mon"), F.lit("09:00-21:00"), F.lit("sat"), F.lit("10:00-18:00"), F.lit("sun"),
                         F.when(F.col("n_regionkey") == 0, F.lit(None).cast("string")).otherwise(F.lit("10:00-16:00")))
    rec = F.struct(F.col("n_nationkey").alias("branch_id"), F.col("n_name").alias("name"),
                   F.lower("n_name").alias("code"), F.lit(None).cast("string").alias("address"),
                   F.lit(None).cast("string").alias("phone"), F.col("k").alias("chairs_count"), hours.alias("working_hours"),
                   F.col("k").alias("doctors_count"), F.lit(True).alias("is_active"),
                   F.lit(None).cast("date").alias("opened_date"), F.lit(None).cast("timestamp").alias("updated_at"))
    return x.select(F.to_json(rec).alias("json"))


def service_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11 input: one service per part name; price list per brand (<= 25)."""
    p = read(spark, sf_dir, "part")
    br = p.groupBy("p_name", "p_brand").agg(F.min(F.col("p_retailprice").cast("decimal(10,2)")).alias("price"))
    lst = br.groupBy("p_name").agg(F.array_sort(F.collect_list(F.struct(
        F.substring("p_brand", 7, 3).try_cast("int").alias("branch_id"), F.col("p_brand").alias("branch_name"),
        F.col("price")))).alias("prices"))
    base = p.groupBy("p_name").agg(F.min("p_partkey").cast("int").alias("sid"), F.min("p_type").alias("code"),
                                   F.min(F.col("p_retailprice").cast("decimal(10,2)")).alias("base_price"))
    x = base.join(lst, "p_name", "left")
    rec = F.struct(F.col("sid").alias("service_id"), "code", F.col("p_name").alias("name"),
                   classify_by_rules("p_name", DRIVER_SERVICE_RULES, DRIVER_SERVICE_DEFAULT).alias("category"),
                   F.lit(None).cast("string").alias("subcategory"), "base_price", F.col("prices").alias("prices_by_branch"),
                   F.lit(30).alias("duration_minutes"), F.lit(True).alias("is_active"),
                   F.lit(None).cast("timestamp").alias("updated_at"))
    return x.select(F.to_json(rec).alias("json"))


def appointment_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12 input: one appointment per order."""
    x = _orders_with_patient(spark, sf_dir)
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    rec = F.struct(
        F.col("o_orderkey").alias("appointment_id"), F.to_date("o_orderdate").alias("date"),
        F.lit("09:00").alias("time_start"), F.lit("09:30").alias("time_end"), F.lit(30).alias("duration_minutes"),
        F.struct(F.col("c_nationkey").alias("id"), F.col("n_name").alias("name")).alias("branch"),
        F.lit(None).cast(SC.APPOINTMENT["doctor"].dataType).alias("doctor"),
        F.struct(F.col("patient_hash").alias("id"), F.lit(None).cast("int").alias("age"), _age_group().alias("age_group")).alias("patient"),
        F.when(pr == "1-URGENT", "primary").otherwise("repeat").alias("visit_type"), F.lit(None).cast("string").alias("reason"),
        F.when(st == "F", "completed").when(st == "P", "cancelled").when(st == "O", "no_show").alias("status"),
        pr.alias("source"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    return x.select(F.to_json(rec).alias("json"))


def invoice_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13 input: one invoice per order with items and payments."""
    x = _orders_with_patient(spark, sf_dir)
    sv = _services_by_order(spark, sf_dir).drop("services")
    x = x.join(sv, x.o_orderkey == sv.l_orderkey, "inner")
    st = F.col("o_orderstatus")
    total = F.col("subtotal") - F.col("discount_total")
    paid = F.when(st == "F", total).otherwise(F.lit(0))
    pay_t = SC.INVOICE["payments"].dataType
    rec = F.struct(
        F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_id"),
        F.to_date("o_orderdate").alias("created_date"),
        F.struct(F.col("c_nationkey").alias("id"), F.col("n_name").alias("name")).alias("branch"),
        F.struct(F.col("patient_hash").alias("id"), _age_group().alias("age_group")).alias("patient"),
        F.lit(None).cast(SC.IDNAME).alias("doctor"), F.col("items"),
        F.col("subtotal").cast(MONEY).alias("subtotal"), F.col("discount_total").cast(MONEY).alias("discount_total"),
        total.cast(MONEY).alias("total_amount"), paid.cast(MONEY).alias("paid_amount"),
        (total - paid).cast(MONEY).alias("debt"), st.alias("status"),
        F.when(st == "F", F.array(F.struct(F.to_date("o_orderdate").alias("payment_date"), total.cast(MONEY).alias("amount"),
                                           F.col("o_orderpriority").alias("payment_type"))))
        .otherwise(F.array().cast(pay_t)).alias("payments"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    return x.select(F.to_json(rec).alias("json"))


SEGMENT_BUCKET = {"HOUSEHOLD": "0_17", "AUTOMOBILE": "18_30", "BUILDING": "31_45", "FURNITURE": "46_60",
                  "MACHINERY": "60_plus"}


def patient_stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14 input: per month x nation patient counts, segments as age buckets."""
    x = _order_frame(spark, sf_dir)
    seg = F.col("c_mktsegment")
    g = x.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period"), "c_nationkey", "n_name").agg(
        F.count_distinct("o_custkey").cast("int").alias("tp"), F.count(F.lit(1)).alias("no"),
        *[F.count_distinct(F.when(seg == s, F.col("o_custkey"))).cast("int").alias(b) for s, b in SEGMENT_BUCKET.items()])
    rec = F.struct(
        "period", F.struct(F.col("c_nationkey").alias("id"), F.col("n_name").alias("name")).alias("branch"),
        F.col("tp").alias("total_patients"), F.lit(None).cast("int").alias("new_patients"),
        F.lit(None).cast("int").alias("returning_patients"), F.lit(None).cast("double").alias("retention_rate"),
        F.lit(None).cast("double").alias("avg_age"),
        F.struct(*[F.col(b).alias(b) for b in SC.AGE_BUCKETS]).alias("age_distribution"),
        (F.col("no").cast("double") / F.col("tp").cast("double")).alias("avg_visits_per_patient"),
        F.lit(None).cast(MONEY).alias("avg_revenue_per_patient"), F.lit(None).cast(MONEY).alias("avg_ltv"))
    return g.select(F.to_json(rec).alias("json"))


def transaction_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15 input: transactions in pages of 1,000 (by order key) with cursor
    pagination, landed by three syncs of different length; the last page of a
    sync says ``has_more = false``; a stale copy of the first page sits *after*
    the terminal page and must be ignored."""
    x = _orders_with_patient(spark, sf_dir).withColumn("page_no", F.floor(F.col("o_orderkey") / PAGE_SIZE).cast("long"))
    total = read(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()
    pages = x.groupBy("page_no").agg(F.array_sort(F.collect_list(transaction_record(x, with_services=False))).alias("data"))
    turn = F.pmod(F.col("page_no"), F.lit(6))
    pages = pages.withColumn("sync_id", F.when(turn == 0, "a").when(turn < 3, "b").otherwise("c"))
    ends = pages.groupBy("sync_id").agg(F.max("page_no").alias("last_no"))
    pages = pages.join(F.broadcast(ends), "sync_id")  # three rows; pages never move by sync, one of which holds half of them
    has_more = F.col("page_no") < F.col("last_no")
    env = pages.select("sync_id", "page_no", "data", F.struct(
        F.when(has_more, (F.col("page_no") + 1).cast("string")).alias("cursor"), has_more.alias("has_more"),
        total.cast("long").alias("total_count")).alias("pagination"))
    stale = env.where(F.col("page_no") == 0).withColumn("page_no", F.lit(STALE_PAGE).cast("long"))
    return env.unionByName(stale).select(F.to_json(F.struct("sync_id", "page_no", "data", "pagination")).alias("json"))


# ------------------------------------------------------------- landing ----
# Rendered inputs are landed once per session as real files under the shared
# checkpoint folder and read back through the production readers
# (explicit-schema CSV / JSON / Parquet), exactly as uploaded files would be.
# Text is gzipped (a tenth of its size); a gzipped file is read by one task, so
# a file ends after so many rows, however large the task that writes it.
FILE_ROWS, PAGE_FILE_ROWS = 500_000, 500
_LANDED: dict = {}

BUILDERS = {
    "transactions": (transactions_text, "csv"),
    "cf_journal": (cf_journal_text, "csv"),
    "cost_sheet": (cost_sheet_text, "csv"),
    "leads_sheet": (leads_sheet, "csv"),
    "weekly_sources": (weekly_sources_sheet, "csv"),
    "svod_cells": (svod_cells, "parquet"),
    "clinics_cells": (clinics_cells, "parquet"),
    "transactions_json": (transaction_json, "text"),
    "doctors_json": (doctor_json, "text"),
    "branches_json": (branch_json, "text"),
    "services_json": (service_json, "text"),
    "appointments_json": (appointment_json, "text"),
    "invoices_json": (invoice_json, "text"),
    "patient_stats_json": (patient_stats_json, "text"),
    "transaction_pages": (transaction_pages, "text"),
}


def landed(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Path of the landed input ``name`` (written on first use in a session)."""
    import hashlib
    import os
    from ..session import ensure_checkpoint_dir
    try:
        app = spark.sparkContext.applicationId
    except Exception:
        app = spark.conf.get("spark.app.id", "app")
    key = (app, sf_dir.rstrip("/"), name)
    if key not in _LANDED:
        build, fmt = BUILDERS[name]
        tag = hashlib.sha1(sf_dir.rstrip("/").encode()).hexdigest()[:12]
        path = os.path.join(ensure_checkpoint_dir(spark), "landing", app, tag, name)
        w = build(spark, sf_dir).write.mode("overwrite")
        if fmt != "parquet":
            w = w.option("compression", "gzip").option("maxRecordsPerFile", PAGE_FILE_ROWS if name == "transaction_pages" else FILE_ROWS)
        if fmt == "csv":
            # keep padding and blanks exactly as rendered
            w.option("header", True).option("ignoreLeadingWhiteSpace", False) \
             .option("ignoreTrailingWhiteSpace", False).csv(path)
        elif fmt == "text":
            w.text(path)
        else:
            w.parquet(path)
        _LANDED[key] = path
    return _LANDED[key]
