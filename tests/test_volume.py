"""What moves at volume: landed text is gzipped, hot walks and months stay spread, sums don't travel with patients."""

import datetime as dt
import os
import re
from contextlib import contextmanager
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerline.operators import conform as C, marts as M
from ledgerline.plans import ingest as I
from ledgerline.sources import api as A, feeds as FD
from ledgerline.sources.driver import Warehouse
from ledgerline import schemas as SC

FACT = ("transaction_date date, year_month date, branch_id int, patient_hash string, operation_type string, is_child boolean, "
        "is_primary_visit boolean, doctor_id int, transaction_amount decimal(15,2)")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def _unasked_broadcasts_off(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _fact(spark):
    jan, feb = dt.date(2025, 1, 1), dt.date(2025, 2, 1)
    rows = [(jan, jan, 1, "p1", "payment", True, True, 7, D("10.00")), (jan, jan, 1, "p1", "refund", True, False, 7, D("-4.00")),
            (jan, jan, 1, None, "payment", False, True, 7, D("5.00")), (jan, jan, None, "p2", "payment", None, None, 7, D("1.00")),
            (feb, feb, 1, None, "payment", False, False, None, None), (feb, feb, 2, "p1", "other", False, False, 8, D("3.00"))]
    return spark.createDataFrame(rows, FACT)


def test_f1_landed_text_is_gzipped(spark, sf_dir):
    for name in ("transactions", "transactions_json"):
        parts = [f for f in os.listdir(FD.landed(spark, sf_dir, name)) if f.startswith("part-")]
        assert parts and all(f.endswith(".gz") for f in parts)


def test_f1_shared_patient_counts_are_the_same(spark):
    fact = _fact(spark)
    for mart in (M.revenue_accrual, lambda f, **k: M.branch_comparison(f, spark.createDataFrame([(1, "A")], "branch_id int, display_name string"), **k)):
        own, shared = mart(fact), mart(fact, patients=M.branch_patients(fact))
        assert own.columns == shared.columns and own.dtypes == shared.dtypes
        assert sorted(map(str, own.collect())) == sorted(map(str, shared.collect()))


def test_f1_doctor_rows_move_once_by_ranges(spark):
    docs = spark.createDataFrame([(7, "Doc", "x")], "doctor_id int, full_name string, specialization string")
    k = M.doctor_kpi(_fact(spark), docs, spark.createDataFrame([(1, "A")], "branch_id int, display_name string"))
    assert "rangepartitioning(year_month" in _plan(k) and "hashpartitioning(year_month" not in _plan(k)
    r = {x.branch_id: x for x in k.where("doctor_id = 7").collect()}
    assert (r[1].revenue, r[1].visit_count, r[1].unique_patients, r[1].primary_visits, r[1].avg_ticket) == (D("15.00"), 2, 1, 2, 7.5)


def test_f2_pages_stay_where_they_were_read(spark):
    env = SC.envelope(SC.S(("transaction_id", SC.LongType())))
    pages = spark.createDataFrame([(0, [{"transaction_id": 1}], (None, False, 1)), (1, [{"transaction_id": 2}], (None, False, 1))], env)
    pages = pages.withColumn("sync_id", F.when(F.col("page_no") == 0, "a").otherwise("b"))
    with _unasked_broadcasts_off(spark):
        got = A.explode_pages(pages, keys=["sync_id"])
        assert "BroadcastHashJoin" in _plan(got) and "SortMergeJoin" not in _plan(got)
        assert sorted(r.transaction_id for r in got.collect()) == [1, 2]


def test_f3_pnl_reads_no_parts_and_sums_stay_with_their_branch(spark, sf_dir):
    w = Warehouse(spark, sf_dir)
    pnl = w.pnl
    assert "fact" not in w._frames and not any("part.parquet" in f for f in pnl.inputFiles())
    r = {(x.year_month.month, x.branch_id): x for x in M.revenue_accrual(_fact(spark)).collect()}
    assert len(r) == 4
    x = r[1, 1]
    assert (x.gross_revenue, x.refunds, x.net_revenue, x.unique_patients, x.payment_count, x.primary_visits) == (D("15.00"), D("4.00"), D("11.00"), 1, 2, 2)
    assert (r[1, None].unique_patients, r[1, None].net_revenue) == (1, D("1.00"))
    assert (r[2, 1].unique_patients, r[2, 1].gross_revenue, r[2, 1].avg_ticket) == (0, None, None)  # one payment without an amount
    assert "_measured" in _plan(M.revenue_accrual(_fact(spark)))


def test_f4_f6_lines_move_as_plain_columns(spark, sf_dir):
    for build in (FD.transaction_json, FD.invoice_json):
        assert "REPARTITION_BY_COL" in _plan(build(spark, sf_dir))


def test_f5_small_dimensions_are_broadcast(spark, sf_dir):
    from ledgerline.sources.seeds import local_table
    w = Warehouse(spark, sf_dir)
    codes = local_table(spark, [("1", 50)], "code string, payment_type_id int")
    with _unasked_broadcasts_off(spark):
        plan = _plan(C.conform_api_fact(I._flat_tx(spark, sf_dir), w.branches, codes, w.services, w.doctors))
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 4


def test_f6_landed_invoices_are_gzipped(spark, sf_dir):
    parts = [f for f in os.listdir(FD.landed(spark, sf_dir, "invoices_json")) if f.startswith("part-")]
    assert parts and all(f.endswith(".gz") for f in parts)
    assert I._json(spark, sf_dir, "invoices_json", SC.INVOICE).count() == FD.invoice_json(spark, sf_dir).count() > 0


def test_f6_lines_a_task_dont_grow_with_the_input(spark, sf_dir, monkeypatch):
    for build in (FD.transaction_json, FD.invoice_json):
        with monkeypatch.context() as m, _unasked_broadcasts_off(spark):
            want = sorted(r.json for r in build(spark, sf_dir).collect())
            m.setattr(FD, "LINE_BYTES", os.path.getsize(f"{sf_dir}/lineitem.parquet") // 9)  # the session has 4 partitions
            got = build(spark, sf_dir)
            tasks = {k: int(n) for k, n in re.findall(r"hashpartitioning\(([lo]_orderkey)#\d+L, (\d+)\)", _plan(got))}
            assert tasks["l_orderkey"] == tasks["o_orderkey"] >= 9
            assert sorted(r.json for r in got.collect()) == want
