"""Snapshot tables, high-water marks, endpoint streams: replays, failures, parts that become empty, ids in order."""

import datetime as dt
import os
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.operators import _order, conform as C
from ledgerline.snapshots import HighWaterMarks, Snapshot, refresh_parts
from ledgerline.streaming import endpoints as E

ROWS = "k int, ts int, id int, v string"
JAN, FEB, MAR = (dt.date(2025, m, 1) for m in (1, 2, 3))


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="ll-snap-")


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_merge_replay_and_untouched_parts(spark, root):
    t = Snapshot.by_key(spark, f"{root}/t", "k", buckets=4)
    make = lambda *r: spark.createDataFrame(list(r), ROWS)
    assert t.merge(make((1, 1, 1, "a"), (2, 1, 2, "b"), (3, 5, 3, "c"), (None, 1, 4, "n")), "k", "ts", "id", "w", 0)
    first = t.head()
    assert not t.merge(make((1, 9, 9, "replayed")), "k", "ts", "id", "w", 0)      # the batch is known
    assert t.merge(make((1, 2, 5, "a2"), (2, 0, 6, "late")), "k", "ts", "id", "w", 1)
    assert rows(t.read()) == Counter([(1, 2, 5, "a2"), (2, 1, 2, "b"), (3, 5, 3, "c"), (None, 1, 4, "n")])
    assert t.head().number == 2 and rows(t.read(head=first))[(1, 1, 1, "a")] == 1  # earlier versions can still be read
    touched = set(t.parts_of(make((1, 0, 0, ""), (2, 0, 0, ""))))
    assert all(t.head().parts[p] == d for p, d in first.parts.items() if p not in touched)
    assert t.merge(make((4, 1, 1, "d")), "k", "ts", "id", "other", 0)              # each writer has its own numbers


def test_a_commit_that_fails_changes_nothing(spark, root):
    t = Snapshot.by_column(spark, f"{root}/t", "k")
    t.replace(spark.createDataFrame([(1, "a")], "k int, v string"))
    bad = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string").withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        t.replace(bad)
    assert rows(t.read()) == Counter([(1, "a")])
    with pytest.raises(ValueError):
        Snapshot.by_column(spark, f"{root}/u", "v").replace(spark.createDataFrame([(1, "a/b")], "k int, v string"))
    with pytest.raises(FileNotFoundError):
        Snapshot.by_column(spark, f"{root}/u", "v").read()


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_months_that_become_empty_are_gone(spark, root, mode):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    try:
        schema = "year_month date, branch int, amount int"
        t = Snapshot.by_column(spark, f"{root}/t", "year_month")
        t.replace(spark.createDataFrame([(JAN, 1, 10), (FEB, 1, 20), (MAR, 1, 30), (None, 1, 5)], schema))
        kept = t.head().parts[str(MAR)]
        touched = spark.createDataFrame([(JAN,), (FEB,), (FEB,)], "year_month date")
        assert refresh_parts(t, lambda: spark.createDataFrame([(FEB, 1, 21), (FEB, 2, 10)], schema), touched) == [str(JAN), str(FEB)]
        assert rows(t.read()) == Counter([(FEB, 1, 21), (FEB, 2, 10), (MAR, 1, 30), (None, 1, 5)])
        assert t.head().parts[str(MAR)] == kept
        t.replace(spark.createDataFrame([(FEB, 9, 9)], schema))                      # a full rebuild
        assert rows(t.read()) == Counter([(FEB, 9, 9)])
        t.replace(spark.createDataFrame([], schema))
        assert t.read().count() == 0
        t.append(spark.createDataFrame([(FEB, 9, 9)], schema), "w", 1)
        t.append(spark.createDataFrame([(FEB, 9, 9)], schema), "w", 1)
        t.append(spark.createDataFrame([(FEB, 9, 9)], schema), "w", 2)
        assert t.read().count() == 2
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def test_full_reload_drops_vanished_months(spark, root, monkeypatch):
    from ledgerline import etl
    from ledgerline.sources.driver import dim_branch
    schema = "year_month date, branch_id int"
    monkeypatch.setattr(etl, "monthly_pnl", lambda fact, *a: fact.groupBy("year_month", "branch_id").count())
    monkeypatch.setattr(etl, "doctor_kpi", etl.monthly_pnl)
    monkeypatch.setattr(etl, "branch_comparison", etl.monthly_pnl)
    spark.createDataFrame([(1, "x")], "doctor_id int, full_name string").write.parquet(f"{root}/dwh/dim_doctor")
    for months in ([JAN, FEB], [FEB, MAR]):
        spark.createDataFrame([(m, 1) for m in months], schema).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{root}/dwh/fact_transactions")
        etl.refresh(spark, root, dim_branch(spark, "/root/testdata/sf0.001"))
        assert {r[0] for r in spark.read.parquet(f"{root}/marts/branch_comparison").select("year_month").collect()} == set(months)


def test_a_mark_moves_only_after_the_commit(spark, root):
    marks, table = HighWaterMarks(spark, f"{root}/marks"), Snapshot.by_key(spark, f"{root}/t", "k")
    merge = lambda d: table.merge(d, "k", "ts", "id")
    make = lambda *r: spark.createDataFrame(list(r), ROWS)
    assert marks.load("e", make((1, 1, 1, "a"), (2, 3, 2, "b")), "ts", merge) == 3 and marks.get("e") == 3

    def lost(delta):
        assert delta.count() == 3
        raise ConnectionError
    later = make((1, 1, 1, "a"), (2, 3, 2, "b"), (3, 3, 3, "same time"), (1, 7, 4, "a7"))
    with pytest.raises(ConnectionError):
        marks.load("e", later, "ts", lost)
    assert marks.get("e") == 3 and marks.get("other") is None
    assert marks.load("e", later, "ts", merge) == 7
    assert marks.load("other", make((9, 2, 9, "x")), "ts", merge) == 2 and marks.get("e") == 7
    assert {r["v"] for r in table.read().collect()} == {"a7", "b", "same time", "x"}
    assert marks.load("e", make(), "ts", lost) == 7                                # nothing new: no commit


def land(spark, df, path):
    """One more file in a landing folder."""
    df.coalesce(1).write.mode("append").parquet(path)


def test_endpoints_are_bounded_isolated_and_replayable(spark, root):
    schema = StructType.fromDDL(ROWS)
    make = lambda *r: spark.createDataFrame(list(r), ROWS)
    for i in range(4):
        land(spark, make((1, i, i, f"v{i}"), (10 + i, 0, i, "x")), f"{root}/in")
    bad = StructType.fromDDL(ROWS + ", extra int")

    def ends():
        merged = E.Endpoint("merged", f"{root}/in", schema, Snapshot.by_key(spark, f"{root}/m", "k"), E.MERGE, "k", "ts", "id")
        plain = E.Endpoint("plain", f"{root}/in", schema, Snapshot.by_key(spark, f"{root}/a", "k"), E.APPEND)
        whole = E.Endpoint("whole", f"{root}/in", schema, Snapshot.by_key(spark, f"{root}/r", "k"), E.REPLACE)
        fails = E.Endpoint("fails", f"{root}/in", bad, Snapshot.by_key(spark, f"{root}/f", "nothing"), E.APPEND)
        return [merged, plain, whole, fails]
    ran = {r["endpoint"]: r for r in E.run_endpoints(spark, ends(), f"{root}/ck", max_files=1).collect()}
    assert [ran[n]["rows"] for n in ("merged", "plain", "whole")] == [8, 8, 8] and ran["plain"]["error"] is None
    assert ran["fails"]["rows"] is None and ran["fails"]["error"]
    merged, plain, whole, _ = ends()
    assert merged.table.head().number == plain.table.head().number == 4           # one file a batch
    assert {(r["k"], r["v"]) for r in merged.table.read().collect()} == {(1, "v3")} | {(10 + i, "x") for i in range(4)}
    assert plain.table.read().count() == 8 and whole.table.read().count() == 2
    again = {r["endpoint"]: r["rows"] for r in E.run_endpoints(spark, ends()[:3], f"{root}/ck", max_files=1).collect()}
    assert again == {"merged": 0, "plain": 0, "whole": 0} and plain.table.read().count() == 8
    plain.writer(f"{root}/ck/plain")(make((5, 5, 5, "replayed")), 3)                # a batch delivered twice
    assert plain.table.read().count() == 8
    with pytest.raises(ValueError):
        E.Endpoint("x", "y", schema, merged.table, "sometimes")


def test_daily_totals_over_batches_keep_open_days(spark, root):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from ledgerline.streaming.incremental import events_daily
    os.makedirs(f"{root}/in")
    day = lambda d, h: dt.datetime(2025, 1, d, h)
    parts = [[(1, day(1, 1), "a", 1.0), (2, day(1, 23), "b", 2.0)], [(3, day(2, 0), "a", 4.0), (1, day(1, 1), "a", 1.0), (4, day(1, 5), "a", 8.0)], [(5, day(2, 1), "a", 16.0)]]
    for i, p in enumerate(parts):
        pq.write_table(pa.table({"event_id": pa.array([r[0] for r in p]), "ts": pa.array([r[1] for r in p], pa.timestamp("us", tz="UTC")),
                                 "event_type": pa.array([r[2] for r in p]), "value": pa.array([r[3] for r in p])}), f"{root}/in/f{i}.parquet")
    schema = spark.read.parquet(f"{root}/in").schema
    table = Snapshot.by_key(spark, f"{root}/t", ["window_start", "event_type"], buckets=2)
    for _ in range(2):
        E.stream_daily_totals(spark, f"{root}/in", schema, table, f"{root}/ck", max_files=1)
    got = {(r["window_start"], r["event_type"]): (r["events"], float(r["value_sum"])) for r in table.read().collect()}
    want = {(r["window_start"], r["event_type"]): (r["events"], r["value_sum"]) for r in events_daily(spark.read.parquet(f"{root}/in").dropDuplicates(["event_id"])).collect()}
    assert got == want and len(got) == 3


def test_ids_in_order_without_one_task(spark):
    names = [(f"n{i:04d}",) for i in range(700)]
    dim = spark.createDataFrame([(5, "n0003"), (9, "zz")], "doctor_id int, full_name string")
    out = C.upsert_dimension(spark.createDataFrame(names, "name string"), dim, "name", "doctor_id", dim_key="full_name")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    new = {r["full_name"]: r["doctor_id"] for r in out.collect() if r["is_new"]}
    assert new == {n: 10 + i for i, n in enumerate(sorted(n for n, in names if n != "n0003"))}
    assert out.schema["doctor_id"].dataType.simpleString() == "int"
    got = _order.ranked(spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "a int, i int"), [F.desc("a")], "place").collect()
    assert all(r["place"] == 50 - r["a"] for r in got)


def test_run_all_skips_and_isolates(spark, sf_dir, root):
    """Sources that are named but absent are skipped, a broken one is reported, and the marts are made all the same."""
    from ledgerline import etl, vocab
    from ledgerline.sources import feeds as FD
    from ledgerline.sources.driver import dim_branch
    from ledgerline.sources.seeds import payment_types
    land(spark, spark.createDataFrame([("x", 0, 1, 1, "y")], "source_file string, sheet string, row_idx int, col_idx int, nothing string"), f"{root}/bad_cells")
    sources = {"transactions": FD.landed(spark, sf_dir, "transactions"), "clinics_cells": f"{root}/bad_cells", "journal": f"{root}/absent", "costs": FD.landed(spark, sf_dir, "cost_sheet")}
    ran = {r["step"]: r for r in etl.run_all(spark, f"{root}/w", sources, FD.branch_aliases(spark, sf_dir), dim_branch(spark, sf_dir), payment_types(spark), clinics=["y"]).collect()}
    assert ran["transactions"]["rows"] > 0 and ran["costs"]["rows"] > 0 and "leads" not in ran
    assert ran["journal"]["error"] == "skipped: input missing" and ran["cash_flow"]["error"] and ran["cash_flow"]["rows"] is None
    assert all(ran[f"mart {m}"]["error"] is None for m in ("monthly_pnl", "doctor_kpi", "branch_comparison", "service_economics", "alerts"))
    assert ran["mart monthly_pnl"]["rows"] > 0 and spark.read.parquet(f"{root}/w/marts/service_economics").count() == ran["mart service_economics"]["rows"]
