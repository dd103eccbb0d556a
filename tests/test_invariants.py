"""Invariants on the driver data (sf0.001)."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import reports as R, marts as M
from ledgerline.sources.driver import Warehouse


@pytest.fixture(scope="module")
def wh(spark, sf_dir):
    return Warehouse.of(spark, sf_dir)


def test_net_is_gross_minus_refunds(wh):
    bad = wh.pnl.where(F.col("revenue_accrual") != F.col("gross_revenue") - F.col("refunds")).count()
    assert bad == 0


def test_ebitda_identity(wh):
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    e = (z("revenue_accrual") - z("materials") - z("lab") - z("payroll_doctors") - z("payroll_assistants")
         - z("rent") - z("marketing") - z("it_costs"))
    assert wh.pnl.where(F.col("ebitda") != e).count() == 0


def test_bridge_total_equals_running_level(wh):
    b = R.ebitda_bridge(wh.pnl).orderBy("ordinal").collect()
    assert b[-1].value == b[-2].level


def test_shares_sum_to_one(wh):
    s = R.revenue_share(wh.pnl).agg(F.sum("share")).collect()[0][0]
    assert s == pytest.approx(1.0, abs=1e-4)


def test_children_plus_adult_not_above_revenue(wh):
    bc = wh.branch_comparison
    bad = bc.where(F.coalesce("children_revenue", F.lit(0)) + F.coalesce("adult_revenue", F.lit(0))
                   > F.coalesce("revenue", F.lit(0))).count()
    assert bad == 0


def test_last_balance_is_net_total(wh):
    bal = R.cumulative_balance(wh.cf_lines).orderBy(F.desc("year_month")).first().balance
    k = R.cashflow_kpis(wh.cf_lines).first()
    assert bal == k.net


def test_marts_have_no_decimal_overflow(wh):
    for df in (wh.pnl, wh.doctor_kpi, wh.branch_comparison):
        assert df.count() > 0


def test_flagship_plan_shape(wh):
    """Aggregation happens before the full outer join; no cartesian product."""
    plan = wh.pnl._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_warehouse_table_mode_matches_persist(spark, sf_dir, wh):
    """The durable mode (fact written to the shared folder, month-partitioned)
    gives the same marts as the in-memory mode."""
    spark.conf.set("ledgerline.warehouse.mode", "table")
    try:
        t = Warehouse.of(spark, sf_dir)
        assert t.mode == "table"
        cols = ["year_month", "branch_id", "revenue_accrual", "ebitda", "unique_patients"]
        a = sorted(map(tuple, t.pnl.select(*cols).collect()), key=str)
        b = sorted(map(tuple, wh.pnl.select(*cols).collect()), key=str)
        assert a == b
        assert "year_month" in t.fact.columns
    finally:
        spark.conf.unset("ledgerline.warehouse.mode")


def test_patient_stats_identities(spark, sf_dir, wh):
    """Source identity: the five age buckets add up to the patient total;
    retention = returning / total."""
    import __spark_entry__ as E
    ps = E.queries()["flatten_patient_stats"](spark, sf_dir)
    buckets = sum(F.col(f"age_{b}") for b in ["0_17", "18_30", "31_45", "46_60", "60_plus"])
    assert ps.where(buckets != F.col("total_patients")).count() == 0
    from ledgerline.operators.statements import patient_stats
    st = patient_stats(wh.fact)
    bad = st.where(F.abs(F.col("retention_rate") - F.col("returning_patients") / F.col("total_patients")) > 1e-6)
    assert bad.count() == 0
    assert st.where(F.col("new_patients") + F.col("returning_patients") != F.col("total_patients")).count() == 0


def test_patient_stats_sets_levels(wh):
    from ledgerline.operators.statements import patient_stats, patient_stats_sets
    s = patient_stats_sets(wh.fact)
    cols = ["year_month", "branch_id", "total_patients", "new_patients", "avg_ltv"]
    a = sorted(map(tuple, s.where("level = 'year_month,branch_id'").select(*cols).collect()), key=str)
    b = sorted(map(tuple, patient_stats(wh.fact).select(*cols).collect()), key=str)
    assert a == b
    total = s.where("level = 'all'").first()
    distinct = wh.fact.where(F.col("patient_hash").isNotNull()).select("patient_hash").distinct().count()
    assert total.total_patients == distinct == total.new_patients
