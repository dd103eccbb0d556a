"""Micro fixtures (5-10 literal rows) for the semantic traps of the source."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerline import vocab
from ledgerline.functions import (classify_by_rules, parse_date_any, parse_year_month, first_listed_date,
                                  patient_hash)
from ledgerline.operators import marts as M, reports as R, planning as P, conform as C
from ledgerline.sources import api as A, grid as G, files as FI
from ledgerline import schemas as SC

FACT = ("transaction_date date, year_month date, branch_id int, patient_hash string, operation_type string, "
        "is_child boolean, is_primary_visit boolean, service_name string, doctor_id int, "
        "transaction_amount decimal(15,2)")
CF = "year_month date, branch_id int, line_item string, amount decimal(15,2)"
BR = "branch_id int, name string, code string, display_name string, legal_entity_id int"

JAN, FEB, MAR, APR = dt.date(2025, 1, 1), dt.date(2025, 2, 1), dt.date(2025, 3, 1), dt.date(2025, 4, 1)


def fact_row(d, branch, patient, op, amount, primary=False, child=False, service="svc", doctor=1):
    return (d, d.replace(day=1), branch, patient, op, child, primary, service, doctor, D(amount))


@pytest.fixture
def branches(spark):
    return spark.createDataFrame([(1, "A", "a", "Alpha", 1), (2, "B", "b", "Beta", 1)], BR)


def test_pnl_full_outer_null_branch_and_cash_only(spark, branches):
    fact = spark.createDataFrame([
        fact_row(dt.date(2025, 1, 5), 1, "p1", "payment", "100.00", primary=True),
        fact_row(dt.date(2025, 1, 6), None, "p2", "payment", "50.00"),
    ], FACT)
    cf = spark.createDataFrame([
        (JAN, 1, "Выручка от услуг", D("90.00")), (JAN, 1, "Расходные материалы", D("-10.00")),
        (JAN, None, "Аренда офиса", D("-5.00")),               # NULL branch: never matches
        (FEB, 2, "Аренда помещений", D("-7.00")),              # cash-only month
    ], CF)
    pnl = M.monthly_pnl(fact, cf, branches).collect()
    rows = {(r.year_month, r.branch_id, r.revenue_accrual is None): r for r in pnl}
    assert len(pnl) == 4  # (JAN,1), fact (JAN,NULL), cash (JAN,NULL), cash-only (FEB,2)
    a = rows[(JAN, 1, False)]
    assert a.revenue_cash == D("90.00") and a.materials == D("10.00") and a.ebitda == D("90.00")
    assert a.branch_name == "Alpha"
    cash_only = rows[(FEB, 2, True)]
    assert cash_only.rent == D("7.00") and cash_only.ebitda == D("-7.00") and cash_only.gross_revenue is None
    nulls = [r for r in pnl if r.branch_id is None]
    assert len(nulls) == 2 and all(r.branch_name is None for r in nulls)


def test_overlapping_patterns_and_no_match(spark):
    cf = spark.createDataFrame([(JAN, 1, "материалы для лаборатории", D("-3.00")),
                                (JAN, 2, "прочее", D("-4.00"))], CF)
    r = {x.branch_id: x for x in M.cf_summary(cf).collect()}
    assert r[1].materials == D("3.00") and r[1].lab == D("3.00")   # one line, two buckets
    assert r[2].materials is None and r[2].rent is None             # nothing matched -> NULL, not 0
    # the two-letter Latin pattern case-folds into any "it"
    cf2 = spark.createDataFrame([(JAN, 1, "credit card fee", D("-1.00"))], CF)
    assert M.cf_summary(cf2).collect()[0].it_costs == D("1.00")


def test_refunds_only_month(spark, branches):
    fact = spark.createDataFrame([fact_row(dt.date(2025, 3, 3), 1, "p", "refund", "-20.00")], FACT)
    r = M.revenue_accrual(fact).collect()[0]
    assert r.gross_revenue == 0 and r.refunds == D("20.00") and r.net_revenue == D("-20.00")
    assert r.avg_ticket is None and r.payment_count == 0
    docs = spark.createDataFrame([(1, "Doc", "x")], "doctor_id int, full_name string, specialization string")
    k = M.doctor_kpi(fact, docs, branches).collect()[0]
    assert k.revenue is None and k.revenue_per_workday is None and k.unique_patients == 1


def _pnl_frame(spark, rows):
    cols = ["year_month", "branch_id", "branch_name"] + R.PNL_METRICS + ["avg_ticket", "unique_patients",
                                                                         "primary_visits", "payment_count"]
    out = []
    for ym, b, rev, eb, tick in rows:
        vals = {m: D("0") for m in R.PNL_METRICS}
        vals.update(revenue_accrual=D(rev), ebitda=D(eb), gross_revenue=D(rev), gross_margin=D(rev))
        out.append((ym, b, f"B{b}", *[vals[m] for m in R.PNL_METRICS], tick, 10, 5, 4))
    schema = ("year_month date, branch_id int, branch_name string, " +
              ", ".join(f"{m} decimal(25,2)" for m in R.PNL_METRICS) +
              ", avg_ticket double, unique_patients bigint, primary_visits bigint, payment_count bigint")
    return spark.createDataFrame(out, schema).select(*cols)


def test_kpi_mom_is_calendar_based(spark):
    pnl = _pnl_frame(spark, [(JAN, 1, "100", "10", 5.0), (MAR, 1, "120", "12", 6.0)])  # February missing
    r = {x.year_month: x for x in R.kpi_mom(pnl).collect()}
    assert r[MAR].revenue_prev is None and r[MAR].revenue_change_pct is None
    pnl2 = _pnl_frame(spark, [(JAN, 1, "0", "10", 5.0), (FEB, 1, "120", "12", 6.0)])
    r2 = {x.year_month: x for x in R.kpi_mom(pnl2).collect()}
    assert r2[FEB].revenue_prev == 0 and r2[FEB].revenue_change_pct is None   # zero base -> no value


def test_service_economics_fanout_and_having(spark, branches):
    rows = [fact_row(JAN, 1, f"p{i}", "payment", "10.00", service="crown") for i in range(5)]
    rows += [fact_row(JAN, 1, f"q{i}", "payment", "10.00", service="filling") for i in range(4)]
    fact = spark.createDataFrame(rows, FACT)
    costs = spark.createDataFrame([("crown", D("1.00"), D("2.00"), 0.5), ("crown", D("3.00"), D("2.00"), 0.4)],
                                  "service_name string, material_cost decimal(10,2), doctor_pay decimal(10,2), margin_pct double")
    out = M.service_economics(fact, costs, branches).collect()
    assert {r.service_name for r in out} == {"crown"}                 # 4 payments: below HAVING >= 5
    assert len(out) == 2 and all(r.service_count == 5 and r.total_revenue == D("50.00") for r in out)
    # identical cost rows land in one group and double it (row-level join semantics)
    dup = spark.createDataFrame([("crown", D("1.00"), D("2.00"), 0.5)] * 2, costs.schema)
    d = M.service_economics(fact, dup, branches).collect()
    assert len(d) == 1 and d[0].service_count == 10
    latest = M.service_economics(fact, costs, branches, latest_cost=True).collect()
    assert len(latest) == 1


def test_classification_first_rule_wins(spark):
    df = spark.createDataFrame([("Имплант и коронка",), ("КТ снимок",), ("чистка",), (None,)], "s string")
    got = [r.c for r in df.select(classify_by_rules("s", vocab.SERVICE_CATEGORY_RULES,
                                                    vocab.SERVICE_CATEGORY_DEFAULT).alias("c")).collect()]
    assert got == ["Хирургия", "Диагностика", "Прочее", "Прочее"]


def test_patient_hash_trims_unicode_space(spark):
    import hashlib
    want = hashlib.sha256("Иван".encode()).hexdigest()[:16]
    df = spark.createDataFrame([(None,), ("",), ("   ",), ("\tИван ",), (" Иван ",)], "n string")
    got = [r.h for r in df.select(patient_hash("n").alias("h")).collect()]
    assert got == [None, None, None, want, want]


def test_date_parsing(spark):
    df = spark.createDataFrame([("2025-03-04",), ("04.03.2025",), ("abc",), (None,)], "s string")
    got = [r.d for r in df.select(parse_date_any("s").alias("d")).collect()]
    assert got == [dt.date(2025, 3, 4), dt.date(2025, 3, 4), None, None]
    ym = spark.createDataFrame([("2025-1",), ("2025-12",), ("2025-13",), ("abc",)], "s string")
    assert [r.d for r in ym.select(parse_year_month("s").alias("d")).collect()] == \
        [dt.date(2025, 1, 1), dt.date(2025, 12, 1), None, None]
    lst = spark.createDataFrame([(" 2025-02-01 , 2025-03-01",), ("bad, 2025-01-01",)], "s string")
    assert [r.d for r in lst.select(first_listed_date("s").alias("d")).collect()] == [dt.date(2025, 2, 1), None]


def test_json_null_object_absent_and_empty_array(spark):
    docs = [
        '{"transaction_id": 1, "branch": null, "services": [{"service_id": 7, "name": "x", "price": 10.5}], '
        '"patient": {"age_group": "child"}, "visit": {"type": "primary"}}',
        '{"transaction_id": 2}',
        '{"transaction_id": 3, "services": [], "patient": {"age_group": null}}',
    ]
    df = spark.createDataFrame([(d,) for d in docs], "json string")
    r = {x.transaction_id_api: x for x in A.flatten_transactions(A.parse_records(df, "json", SC.TRANSACTION)).collect()}
    assert r[1].branch_id_api is None and r[1].service_id_api == 7 and r[1].service_price == D("10.50")
    assert r[1].is_child is True and r[1].is_primary_visit is True and r[1].services_count == 1
    assert r[2].services_count == 0 and r[2].is_child is False and r[2].service_name is None
    assert r[3].services_count == 0 and r[3].is_child is False
    br = spark.createDataFrame([('{"branch_id": 1, "working_hours": {"mon": "9-21", "sun": null}}',)], "json string")
    b = A.flatten_branches(A.parse_records(br, "json", SC.BRANCH)).collect()[0]
    assert b.working_hours == '{"mon":"9-21","sun":null}'


def test_latest_per_key_versions_and_replay(spark):
    from ledgerline.streaming import latest_per_key
    t1, t2 = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
    df = spark.createDataFrame([(1, t1, 10, "old"), (1, t2, 11, "new"), (1, t2, 11, "new"), (2, t1, 12, "only")],
                               "k int, updated_at timestamp, id int, v string")
    got = {r.k: r.v for r in latest_per_key(df, "k", "updated_at", "id").collect()}
    assert got == {1: "new", 2: "only"}


def test_ranking_ties_and_zero_base(spark):
    pnl = _pnl_frame(spark, [(JAN, 1, "100", "10", 5.0), (JAN, 2, "100", "0", 5.0), (JAN, 3, "0", "0", 1.0)])
    r = R.branch_ranking(pnl).collect()
    assert [x.branch_name for x in r] == ["B1", "B2", "B3"]
    assert r[2].ebitda_margin is None                 # zero revenue -> no margin, no error under ANSI


def test_pnl_statement_total_covers_all_months(spark):
    months = [dt.date(2025, m, 1) for m in range(1, 9)]
    pnl = _pnl_frame(spark, [(m, 1, "10", "1", 1.0) for m in months])
    st = {r.line: r for r in R.pnl_statement(pnl).collect()}
    ebitda = st["EBITDA"]
    assert ebitda.total == D("8.00")                   # all eight months
    assert [getattr(ebitda, f"m{i}") for i in range(1, 7)] == [D("1.00")] * 6
    lines = R.pnl_statement(pnl).collect()
    assert [r.line_no for r in lines] == list(range(1, 14))


def test_ebitda_bridge_ends_at_ebitda(spark):
    pnl = _pnl_frame(spark, [(JAN, 1, "100", "100", 1.0)])
    b = R.ebitda_bridge(pnl).collect()
    assert b[-1].role == "total" and b[-1].level == b[-2].level


def test_upsert_trims_and_assigns_ids(spark):
    dim = spark.createDataFrame([(1, "Dr A"), (2, "Dr B")], "doctor_id int, full_name string")
    inc = spark.createDataFrame([(" Dr A ",), ("Dr C",), ("Dr C",), ("  ",), (None,)], "name string")
    out = C.upsert_dimension(inc, dim, "name", "doctor_id", dim_key="full_name").collect()
    new = [(r.doctor_id, r.full_name) for r in out if r.is_new]
    assert new == [(3, "Dr C")] and len(out) == 3
    hashed = C.upsert_dimension(inc, dim, "name", "doctor_id", dim_key="full_name", id_mode="hash")
    assert hashed.where("is_new").count() == 1


def test_grid_needs_both_headers_and_numeric_nonzero(spark):
    cells = [("f", "s", 0, 2, "2025-1"), ("f", "s", 1, 2, "BR"), ("f", "s", 0, 3, "2025-2"),   # col 3: no entity
             ("f", "s", 5, 1, "Статья"), ("f", "s", 6, 1, " Rent "), ("f", "s", 6, 2, "10"),
             ("f", "s", 6, 3, "20"), ("f", "s", 7, 1, "Zero"), ("f", "s", 7, 2, "0"), ("f", "s", 8, 1, "Text"),
             ("f", "s", 8, 2, "n/a"), ("f", "s", 9, 1, " "), ("f", "s", 9, 2, "5")]
    df = spark.createDataFrame(cells, SC.CELLS)
    out = G.grid_unpivot_svod(df).collect()
    assert [(r.year_month_str, r.legal_entity, r.line_item, r.amount) for r in out] == [("2025-1", "BR", "Rent", 10.0)]


def test_explode_pages_stop_rules(spark):
    env = SC.envelope(SC.S(("transaction_id", SC.LongType())))
    pages = [(0, [{"transaction_id": 1}], ("1", True, 3)), (1, [{"transaction_id": 2}], (None, False, 3)),
             (2, [{"transaction_id": 99}], ("3", True, 3))]                    # after the terminal page
    df = spark.createDataFrame(pages, env)
    assert sorted(r.transaction_id for r in A.explode_pages(df).collect()) == [1, 2]
    empty_first = spark.createDataFrame([(0, [], ("1", True, 0)), (1, [{"transaction_id": 5}], (None, False, 0))], env)
    assert A.explode_pages(empty_first).count() == 0


def test_explode_pages_stops_each_sync_on_its_own(spark):
    from pyspark.sql import functions as F
    env = SC.envelope(SC.S(("transaction_id", SC.LongType())))
    short = spark.createDataFrame([(0, [{"transaction_id": 1}], (None, False, 1)),
                                   (1, [{"transaction_id": 98}], ("2", True, 1))], env)
    long = spark.createDataFrame([(0, [{"transaction_id": 10}], ("1", True, 2)), (1, [{"transaction_id": 11}], (None, False, 2)),
                                  (2, [{"transaction_id": 99}], ("3", True, 2))], env)
    pages = short.withColumn("sync_id", F.lit("a")).unionByName(long.withColumn("sync_id", F.lit("b"))) \
        .unionByName(short.withColumn("sync_id", F.lit(None).cast("string")))
    got = A.explode_pages(pages, keys=["sync_id"]).collect()
    assert sorted((r.sync_id or "-", r.transaction_id) for r in got) == [("-", 1), ("a", 1), ("b", 10), ("b", 11)]


def test_new_patients_mean_the_same_for_all_keys(spark):
    from ledgerline.operators import statements as T
    rows = [("p1", JAN, 1), ("p1", FEB, 2), ("p2", FEB, 2), ("p3", JAN, 1), ("p3", FEB, 1)]
    fact = spark.createDataFrame([(p, m, b, vocab.PAYMENT, 10.0) for p, m, b in rows],
                                 "patient_hash string, year_month date, branch_id int, operation_type string, transaction_amount double")
    by = {r.branch_id: (r.total_patients, r.new_patients) for r in T.patient_stats(fact, keys=("branch_id",)).collect()}
    assert by == {1: (2, 2), 2: (2, 1)}
    sets = T.patient_stats_sets(fact).where("level = 'branch_id'").collect()
    assert {r.branch_id: (r.total_patients, r.new_patients) for r in sets} == by


def test_forecast_shape_and_scenarios(spark):
    months = [dt.date(2024, m, 1) for m in range(1, 13)]
    pnl = _pnl_frame(spark, [(m, 1, "100", "20", 1.0) for m in months])
    f = P.forecast(pnl, horizon=3, growth_pct=0.0).orderBy("step").collect()
    assert [r.year_month for r in f] == [dt.date(2025, 1, 1), dt.date(2025, 2, 1), dt.date(2025, 3, 1)]
    assert f[0].revenue_base == pytest.approx(100 * vocab.SEASONALITY[1])
    assert f[0].revenue_optimistic == pytest.approx(f[0].revenue_base * 1.1)
    assert f[0].ebitda_margin == pytest.approx(20.0)


def test_ingest_rejects_and_missing_columns(spark):
    raw = spark.createDataFrame([("01.02.2025", "Иван", "100.50"), ("bad", "Петр", "5"), ("2025-02-03", None, "x")],
                                "`Дата транзакции` string, `Пациент` string, `Сумма транзакции` string")
    typed = FI.transactions_typed(raw)
    good, rejects = FI.split_rejects(typed)
    assert good.count() == 1 and rejects.count() == 2
    assert good.collect()[0].transaction_amount == D("100.50")
    assert "patient_name" not in typed.columns
    from ledgerline.operators.quality import missing_columns
    assert "Клиника" in missing_columns(raw, vocab.TRANSACTION_COLUMNS)


def test_unpivot_leads_skips_totals_and_empty(spark):
    cols = [vocab.LEAD_LABEL_COLUMN] + vocab.MONTH_NAMES
    rows = [("Первичные", "5", None) + (None,) * 10, ("Итого", "9", "9") + (None,) * 10,
            ("Вторичные", None, "3") + (None,) * 10]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))
    got = sorted((r.lead_type, r.month, r["count"]) for r in FI.unpivot_leads(df, year=2025).collect())
    assert got == [("Вторичные", 2, 3), ("Первичные", 1, 5)]


def test_alerts_fire_on_thresholds(spark):
    pnl = _pnl_frame(spark, [(JAN, 1, "100", "10", 1.0)])
    pnl = pnl.withColumn("refunds", F.lit(D("50.00")).cast("decimal(25,2)"))
    from ledgerline.operators.quality import alerts
    a = alerts(pnl).collect()
    types = {r.alert_type for r in a}
    assert "high_refund" in types
    hr = [r for r in a if r.alert_type == "high_refund"][0]
    assert hr.metric_value == 50.0 and hr.description.startswith("Возвраты достигли 50.0%")


def test_display_columns(spark):
    from ledgerline.functions import fmt_money, fmt_pct, fmt_delta, fill_template
    df = spark.createDataFrame([(1234567.0, 12.345), (950.0, -3.0), (None, None)], "v double, p double")
    assert [x.d for x in spark.createDataFrame([(0.0,)], "p double").select(fmt_delta("p").alias("d")).collect()] == ["● 0.0%"]
    assert [x.m for x in df.select(fmt_money("v").alias("m")).collect()] == ["1 млн ₽", "950 ₽", "—"]
    r = df.select(fmt_money("v", digits=1).alias("m"), fmt_pct("p").alias("p"), fmt_delta("p").alias("d"),
                  fill_template("Оплата труда заняла %.0f%% выручки", F.col("p")).alias("t")).collect()
    assert r[0].m == "1.2 млн ₽" and r[1].m == "950.0 ₽" and r[2].m == "—"
    assert r[0].p == "12.3%" and r[1].d == "▼ 3.0%" and r[0].d == "▲ 12.3%" and r[2].p == "—"
    assert r[0].t == "Оплата труда заняла 12% выручки"


def test_sinks_count_and_month_overwrite(spark, tmp_path):
    from ledgerline.sinks import write_table, write_mart, append_new
    df = spark.createDataFrame([(JAN, 1, 10), (FEB, 1, 20)], "year_month date, branch_id int, v int")
    target = str(tmp_path / "mart")
    assert write_mart(df, target) == 2
    # refresh of February only: January stays
    assert write_mart(spark.createDataFrame([(FEB, 1, 99)], df.schema), target) == 1
    got = sorted((r.year_month, r.v) for r in spark.read.parquet(target).collect())
    assert got == [(JAN, 10), (FEB, 99)]
    dim = str(tmp_path / "dim")
    assert write_table(spark.createDataFrame([("a",), ("b",)], "name string"), dim) == 2
    assert append_new(spark.createDataFrame([("b",), ("c",)], "name string"), spark.read.parquet(dim), "name", dim) == 1
    assert sorted(r.name for r in spark.read.parquet(dim).collect()) == ["a", "b", "c"]


def test_pipeline_isolates_failures(spark):
    from ledgerline.pipeline import run_steps, default_period
    def boom():
        raise RuntimeError("bad input")
    out = {r.step: r for r in run_steps(spark, {"ok": lambda: 3, "bad": boom}).collect()}
    assert out["ok"].rows == 3 and out["ok"].error is None
    assert out["bad"].rows is None and "bad input" in out["bad"].error
    assert default_period(dt.date(2025, 3, 31)) == (dt.date(2025, 3, 1), dt.date(2025, 3, 31))


def test_calendar_fixed_range(spark):
    from ledgerline.sources.calendar import dim_date
    d = dim_date(spark)
    assert d.count() == 2191
    r = d.where(F.col("date_id") == F.lit(dt.date(2025, 1, 5))).first()   # a Sunday
    assert r.day_of_week == 7 and not r.is_workday and r.year_month == "2025-01" and r.week_of_year == 1


def test_instants_order_and_union(spark):
    from ledgerline.functions import parse_instant, local_date
    from ledgerline.operators.marts import mart_order
    from ledgerline.operators.reports import distinct_values
    from ledgerline.sinks import append_frames
    df = spark.createDataFrame([("2025-01-15T23:30:00+03:00",), ("nonsense",)], "s string")
    r = df.select(parse_instant("s").alias("t")).collect()
    assert r[0].t is not None and r[1].t is None
    d = df.select(local_date(parse_instant("s"), "Europe/Moscow").alias("d")).first().d
    assert d == dt.date(2025, 1, 15)
    bc = spark.createDataFrame([(JAN, 1, None), (JAN, 2, D("5.00")), (JAN, 3, D("9.00"))],
                               "year_month date, branch_id int, revenue decimal(15,2)")
    assert [x.branch_id for x in mart_order(bc, "branch_comparison").collect()] == [1, 3, 2]
    assert [x.branch_id for x in distinct_values(bc, "branch_id").collect()] == [1, 2, 3]
    u = append_frames(bc.select("branch_id"), bc.select("branch_id", "revenue"))
    assert u.count() == 6 and u.where("revenue IS NULL").count() == 4


def test_incremental_refresh_rewrites_touched_months_only(spark, branches, tmp_path):
    from ledgerline.operators.refresh import touched_months, refresh_monthly_pnl
    old = [fact_row(dt.date(2025, 1, 5), 1, "p1", "payment", "100.00"),
           fact_row(dt.date(2025, 2, 5), 1, "p2", "payment", "70.00")]
    cf = spark.createDataFrame([(JAN, 1, "аренда", D("-5.00")), (FEB, 1, "аренда", D("-6.00"))], CF)
    target = str(tmp_path / "pnl")
    fact0 = spark.createDataFrame(old, FACT)
    from ledgerline.sinks import write_mart
    write_mart(M.monthly_pnl(fact0, cf, branches), target)
    # the February payment is corrected and moved to March
    new_row = fact_row(dt.date(2025, 3, 2), 1, "p2", "payment", "75.00")
    fact1 = spark.createDataFrame([old[0], new_row], FACT)
    months = touched_months(spark.createDataFrame([new_row], FACT), spark.createDataFrame([old[1]], FACT))
    assert sorted(r.year_month for r in months.collect()) == [FEB, MAR]
    refresh_monthly_pnl(fact1, cf, branches, months, target)
    got = {r.year_month: r for r in spark.read.parquet(target).collect()}
    full = {r.year_month: r for r in M.monthly_pnl(fact1, cf, branches).collect()}
    assert set(got) == set(full) == {JAN, FEB, MAR}
    for m in (JAN, FEB, MAR):
        assert got[m].revenue_accrual == full[m].revenue_accrual and got[m].ebitda == full[m].ebitda


def test_hot_key_holding_a_third_of_rows(spark, branches):
    """One branch / patient / user with a third of all rows: results stay exact
    and the operators aggregate map-side (no window over the raw hot key)."""
    from ledgerline.streaming import latest_per_key
    n = 3000
    rows = [fact_row(dt.date(2025, 1, 1 + i % 28), 1 if i % 3 == 0 else 2 + i % 7, "hot" if i % 3 == 0 else f"p{i}",
                     "payment", "10.00", service="crown" if i % 3 == 0 else f"s{i % 11}") for i in range(n)]
    fact = spark.createDataFrame(rows, FACT)
    ra = {r.branch_id: r for r in M.revenue_accrual(fact).collect()}
    assert ra[1].payment_count == n // 3 and ra[1].unique_patients == 1
    plan = M.revenue_accrual(fact)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("HashAggregate") >= 2
    ev = spark.createDataFrame([(i % 3 == 0 and 7 or i, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i), i)
                                for i in range(n)], "user_id long, ts timestamp, event_id long")
    lp = latest_per_key(ev, "user_id", "ts", "event_id")
    assert lp.where("user_id = 7").first().event_id == max(i for i in range(n) if i % 3 == 0)
    assert "Window" not in lp._jdf.queryExecution().executedPlan().toString()


def test_bounded_broadcast_checks_size(spark, sf_dir):
    from ledgerline.operators._joins import bounded_broadcast, estimated_bytes
    small = spark.read.parquet(f"{sf_dir}/nation.parquet")
    assert estimated_bytes(small) < 1024 * 1024
    assert "broadcast" in bounded_broadcast(small)._jdf.queryExecution().analyzed().toString().lower()
    assert bounded_broadcast(small, max_bytes=0) is small      # over the cap: no hint, planner decides
    unknown = spark.createDataFrame([(1, "a")], "k int, v string")   # no statistics: never hinted
    assert bounded_broadcast(unknown) is unknown


def test_seeds_are_sized_local_tables(spark):
    from ledgerline.sources.seeds import payment_types, expense_types, aliases
    from ledgerline.operators._joins import estimated_bytes
    pt = payment_types(spark)
    assert [r.name for r in pt.orderBy("payment_type_id").collect()] == [n for n, _ in vocab.PAYMENT_TYPES]
    assert estimated_bytes(pt) < 10_000 and estimated_bytes(expense_types(spark)) < 100_000
    al = aliases(spark, {"(Zeta)": "zeta", "O'Neil": "oneil"})
    assert sorted(r.alias for r in al.collect()) == ["(Zeta)", "O'Neil"]


def test_etl_transactions_and_refresh_end_to_end(spark, sf_dir, tmp_path):
    """Landed CSV -> raw -> dimensions -> fact -> marts; a second run adds no
    dimension members (idempotent upsert) and gives the same fact."""
    from ledgerline import etl
    from ledgerline.sources import feeds as FD
    from ledgerline.sources.driver import dim_branch
    from ledgerline.sources.seeds import payment_types
    raw = FD.landed(spark, sf_dir, "transactions")
    root = str(tmp_path / "wh")
    args = (spark, raw, root, FD.branch_aliases(spark, sf_dir), dim_branch(spark, sf_dir), payment_types(spark))
    first = etl.transactions(*args)
    assert first["fact"] == first["raw"] > 0 and first["new_doctors"] > 0
    raw_cols = spark.read.parquet(f"{root}/raw/transactions").columns
    assert "patient_name" not in raw_cols and "patient_hash" in raw_cols
    second = etl.transactions(*args)
    assert second["new_doctors"] == 0 and second["new_services"] == 0 and second["fact"] == first["fact"]
    fact = spark.read.parquet(f"{root}/dwh/fact_transactions")
    assert fact.where(F.col("doctor_id").isNull()).count() == 0       # padded names matched after trimming
    res = etl.refresh(spark, root, dim_branch(spark, sf_dir))
    assert all(isinstance(v, int) and v > 0 for v in res.values()), res


def test_approx_patients_option(spark, branches):
    rows = [fact_row(JAN, 1, f"p{i % 500}", "payment", "1.00") for i in range(3000)]
    fact = spark.createDataFrame(rows, FACT)
    exact = M.revenue_accrual(fact).first().unique_patients
    approx = M.revenue_accrual(fact, approx_patients=0.02).first().unique_patients
    assert exact == 500 and abs(approx - 500) <= 50
    plan = M.revenue_accrual(fact, approx_patients=0.02)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1          # sketch merged map-side: one shuffle


def test_calendar_russian_names(spark):
    from ledgerline.sources.calendar import dim_date
    r = dim_date(spark, dt.date(2025, 3, 3), dt.date(2025, 3, 9), locale="ru").orderBy("date_id").collect()
    assert [x.day_name for x in r][:2] == ["Понедельник", "Вторник"] and r[-1].day_name == "Воскресенье"
    assert r[0].month_name == "Март"


def test_column_helpers(spark):
    from ledgerline.functions import (band, pct_change, safe_div, month_label, signed_by_direction,
                                      monthly_growth_factor, clip_text, flag_equals, iso_weekday)
    df = spark.createDataFrame([(15.0, 10.0, "inflow", 12.0), (45.0, 0.0, "outflow", -10.0), (None, None, None, None)],
                               "a double, b double, d string, g double")
    r = df.select(band("a", [20, 40], ["red", "amber", "green"]).alias("band"), pct_change("a", "b").alias("pc"),
                  safe_div("a", "b").alias("sd"), signed_by_direction("a", "d").alias("s"),
                  monthly_growth_factor("g").alias("gf")).collect()
    assert [x.band for x in r] == ["red", "green", None]
    assert r[0].pc == pytest.approx(50.0) and r[1].pc is None and r[1].sd is None
    assert r[0].s == 15.0 and r[1].s == -45.0
    assert r[0].gf ** 12 == pytest.approx(1.12) and r[1].gf ** 12 == pytest.approx(0.90)
    t = spark.createDataFrame([(JAN, " " + "x" * 300, " Первичный ", None)], "d date, s string, v string, n string")
    x = t.select(month_label("d").alias("m"), month_label("d", True).alias("m2"), clip_text("s").alias("c"),
                 flag_equals("v", "Первичный").alias("f"), flag_equals("n", "Первичный").alias("fn"),
                 iso_weekday(F.lit(dt.date(2025, 1, 5))).alias("w")).first()
    assert x.m == "Jan 2025" and x.m2 == "Jan 25" and len(x.c) == 200 and x.f is True and x.fn is None and x.w == 7


def test_spread_only_widens_narrow_scans(spark, tmp_path):
    """A one-file table is spread to the default parallelism; a scan that is
    already wide (the large-data case) gets no extra shuffle."""
    from ledgerline.sources.driver import spread
    narrow_path, wide_path = str(tmp_path / "narrow"), str(tmp_path / "wide")
    spark.range(1000).coalesce(1).write.parquet(narrow_path)
    n_par = spark.sparkContext.defaultParallelism
    spark.range(0, 100_000, 1, n_par * 4).write.parquet(wide_path)
    narrow, wide = spread(spark.read.parquet(narrow_path)), spread(spark.read.parquet(wide_path))
    assert narrow.rdd.getNumPartitions() == n_par
    assert "Repartition" in narrow._jdf.queryExecution().logical().toString()
    assert "Repartition" not in wide._jdf.queryExecution().logical().toString()
