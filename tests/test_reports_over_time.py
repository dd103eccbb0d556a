"""Costs in force, calendar windows, patients of a period, checks in one scan, and the branch scope in SQL."""

import datetime as dt
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import marts as M, patients as PA, quality as Q, reports as R, scoped, statements as T

D = dt.date
FACT = "year_month date, transaction_date date, branch_id int, patient_hash string, is_child boolean, operation_type string, service_name string, transaction_amount decimal(15,2)"


def month(m, y=2025):
    return D(y, m, 1)


def test_cost_in_force(spark):
    sales = [(month(1), D(2025, 1, d), 1, "p", False, "payment", s, Decimal(10)) for s in ("a", "b", "c") for d in (5, 10, 15, 20)]
    costs = [("a", D(2025, 1, 10), 1.0), ("a", D(2025, 1, 16), 2.0), ("a", D(2025, 1, 25), 9.0), ("b", None, 5.0), ("b", D(2025, 1, 20), 6.0), ("b", D(2025, 1, 20), 7.0)]
    cost = spark.createDataFrame([(s, d, Decimal(c), Decimal(1), .5) for s, d, c in costs], "service_name string, effective_date date, material_cost decimal(10,2), doctor_pay decimal(10,2), margin_pct double")
    branches = spark.createDataFrame([(1, "B")], "branch_id int, display_name string")
    got = M.service_economics_asof(spark.createDataFrame(sales, FACT), cost, branches, min_payments=1).collect()
    assert {(r["service_name"], r["material_cost"] and float(r["material_cost"])): r["service_count"] for r in got} == {
        ("a", None): 1, ("a", 1.0): 2, ("a", 2.0): 1, ("b", 5.0): 3, ("b", 7.0): 1, ("c", None): 4}


def test_calendar_windows_see_gaps(spark):
    pnl = spark.createDataFrame([(1, "B", month(m, y), float(v)) for m, y, v in ((11, 2024, 1), (12, 2024, 3), (1, 2025, 5), (3, 2025, 7), (8, 2025, 9))], "branch_id int, branch_name string, year_month date, avg_ticket double")
    got = {r["year_month"]: (r["prev_ticket"], r["ticket_ma"]) for r in R.ticket_series(pnl).collect()}
    assert got == {month(11, 2024): (None, 1.0), month(12, 2024): (1.0, 2.0), month(1): (3.0, 3.0), month(3): (None, 6.0), month(8): (None, 9.0)}
    years = spark.createDataFrame([(1, month(1, y), Decimal(v), Decimal(0), Decimal(0), Decimal(0)) for y, v in ((2020, 1), (2021, 2), (2023, 3))],
                                  "branch_id int, year_month date, revenue_accrual decimal(15,2), materials decimal(15,2), gross_margin decimal(15,2), ebitda decimal(15,2)")
    lines = T.statement_lines(years, spark.createDataFrame([(1, 5)], "branch_id int, legal_entity_id int")).where("line_name = 'revenue_accrual'").collect()
    assert {r["period_end"].year: r["amount_previous"] for r in lines} == {2020: None, 2021: Decimal(1), 2023: None}


def patients(spark):
    rows = [(1, 1, "a", 30, False), (2, 1, "a", 30, False), (2, 2, "a", 30, False), (2, 1, "b", 12, True), (3, 2, "c", 70, False), (1, 2, "d", None, None), (3, 1, "d", None, None)]
    fact = spark.createDataFrame([(month(m), month(m), b, p, c, "payment", "s", Decimal(10 * m)) for m, b, p, _, c in rows] + [(month(3), month(3), 1, None, None, "payment", "s", Decimal(1))], FACT)
    ages = spark.createDataFrame([("a", 30), ("b", 12), ("c", 70)], "patient_hash string, age int")
    return fact, ages


def test_patients_of_a_period(spark):
    fact, ages = patients(spark)
    base = T.patient_base(fact, by_age_group=True)
    whole = T.patient_report(base, ages, "2025-02-15", "2025-03-31", group_by=[]).first()
    assert (whole["total_patients"], whole["new_patients"], whole["returning_patients"]) == (4, 2, 2)
    assert whole["avg_age"] == pytest.approx(112 / 3, abs=1e-6) and [whole[f"age_{n}"] for n, _, _ in T.AGE_BUCKETS] == [1, 1, 0, 0, 1]
    assert whole["avg_ltv"] == pytest.approx((50 + 20 + 30 + 40) / 4)
    by = {r["branch_id"]: r["total_patients"] for r in T.patient_report(base, ages, "2025-01-01", "2025-03-31", group_by=["branch"]).collect()}
    assert by == {1: 3, 2: 3}
    groups = {r["age_group"]: r["total_patients"] for r in T.patient_report(base, ages, "2025-01-01", "2025-12-31", group_by=["age_group"]).collect()}
    assert groups == {"adult": 2, "child": 1, None: 1}
    assert T.patient_report(base, ages, "2025-01-01", "2025-12-31", group_by=["month"], age_group="child").count() == 1
    assert T.patient_report(base, ages, "2030-01-01", "2030-12-31").count() == 0


def test_the_fact_is_shuffled_once_for_the_patient_base(spark):
    fact, _ = patients(spark)
    path = tempfile.mkdtemp(prefix="ll-pat-") + "/f"
    fact.write.parquet(path)
    base = T.patient_base(spark.read.parquet(path))
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    got = {(r["year_month"], r["branch_id"], r["patient_hash"]): (r["first_month"], r["ltv"]) for r in base.collect()}
    assert len(got) == 7 and got[month(2), 2, "a"] == (month(1), Decimal(50))


def test_bitmaps_merge_to_distinct_patients(spark):
    fact, _ = patients(spark)
    numbers = PA.patient_numbers(fact)
    assert sorted(r["number"] for r in numbers.collect()) == [0, 1, 2, 3]
    bits = PA.patient_bitmaps(fact, numbers)
    assert PA.distinct_patients(bits).first()["distinct_patients"] == 4
    assert {r["branch_id"]: r["distinct_patients"] for r in PA.distinct_patients(bits, ["branch_id"]).collect()} == {1: 3, 2: 3}
    early = PA.distinct_patients(bits.where(F.col("year_month") <= F.lit(month(2))), ["branch_id"])
    assert {r["branch_id"]: r["distinct_patients"] for r in early.collect()} == {1: 2, 2: 2}
    assert PA.distinct_patients(bits.where("branch_id = 99")).first()["distinct_patients"] == 0
    many = spark.range(100_000).select(F.lit(month(1)).alias("year_month"), (F.col("id") % 3).cast("int").alias("branch_id"), F.sha2(F.col("id").cast("string"), 256).alias("patient_hash"))
    big = PA.patient_bitmaps(many, PA.patient_numbers(many))
    assert PA.distinct_patients(big).first()["distinct_patients"] == 100_000
    assert big.count() <= 100_000 // 32768 + 1 + 3      # a branch's patients share buckets


def test_checks_in_one_scan(spark):
    rows = [(1, "ok", 1, 5.0), (2, "bad", 1, None), (3, "ok", 9, 5.0), (4, None, None, 5.0), (5, "bad", 9, None)]
    df = spark.createDataFrame(rows, "id int, code string, doctor int, amount double")
    dim = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    target = tempfile.mkdtemp(prefix="ll-dq-") + "/q"
    found = Q.quarantine(df, target, {"code": ~F.col("code").isin("ok"), "amount": F.col("amount").isNull()}, {"doctor": ("doctor", dim, "k")})
    assert found == {"code": 2, "amount": 2, "doctor": 2, "quarantined": 3, "good": 2}
    kept = spark.read.parquet(target)
    assert {r["id"]: r["dq_mask"] for r in kept.where("dq_bad = 'true'").collect()} == {2: 3, 3: 4, 5: 7}
    assert {r["id"] for r in kept.where("dq_bad = 'false'").collect()} == {1, 4}
    assert set(kept.columns) == {"id", "code", "doctor", "amount", "dq_mask", "dq_bad"}


def test_branch_scope_in_sql(spark):
    path = tempfile.mkdtemp(prefix="ll-scope-") + "/m"
    spark.createDataFrame([(i % 3, i) for i in range(9)], "branch_id int, v int").write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("scope_mart")
    scoped.register_scope(spark, "scope_mart", "my_branch", "one_branch")
    assert spark.sql("SELECT * FROM my_branch").count() == 0                         # unset: nothing
    scoped.set_scope(spark, 2)
    mine = spark.sql("SELECT * FROM my_branch")
    assert {r["v"] for r in mine.collect()} == {2, 5, 8}
    assert "EqualTo(branch_id,2)" in mine._jdf.queryExecution().executedPlan().toString()
    assert {r["v"] for r in spark.sql("SELECT v FROM one_branch(1)").collect()} == {1, 4, 7}
    scoped.set_scope(spark, None)
    assert spark.sql("SELECT * FROM my_branch").count() == 0
    with pytest.raises(ValueError):
        scoped.register_scope(spark, "scope_mart; DROP TABLE x", "v")


def test_documented_api_record_gets_our_ids(spark):
    """Text codes and the API's own ids: every reference is found in our dimensions, or NULL."""
    from ledgerline import schemas as SC
    from ledgerline.operators import conform as C
    from ledgerline.sources import api as A
    record = """{"transaction_id": 1, "transaction_date": "2025-01-15", "branch": {"id": 77, "name": "North", "code": "north"},
      "patient": {"id": "p1", "age": 34, "age_group": "adult"}, "payment_type": {"code": "card", "name": "Card"}, "operation_type": "payment",
      "invoice": {"id": "I", "total_amount": 12500.00, "debt": 0}, "services": [{"service_id": 901, "code": "T1", "name": "Filling", "total": 5000.00}],
      "doctor": {"id": 501, "name": " Dr One ", "specialization": "x"}, "visit": {"date": "2025-01-15", "type": "primary"}, "amount": 12500.00}"""
    other = record.replace('"north"', '"south"').replace('"card"', '"barter"').replace("Filling", "Unknown").replace(" Dr One ", "Nobody")
    rec = A.parse_records(spark.createDataFrame([(record,), (other,)], "json string"), "json", SC.TRANSACTION)
    dims = [spark.createDataFrame(rows, ddl) for rows, ddl in (
        ([(3, "north"), (4, "west")], "branch_id int, code string"), ([("card", 9)], "code string, payment_type_id int"),
        ([(12, "Filling"), (11, "Filling")], "service_id int, name string"), ([(6, "Dr One")], "doctor_id int, full_name string"))]
    got = C.conform_api_fact(A.flatten_transactions(rec), *dims).collect()
    ids = {tuple(r[c] for c in ("branch_id", "payment_type_id", "service_id", "doctor_id")) for r in got}
    assert ids == {(3, 9, 11, 6), (None, None, None, None)} and len(got) == 2
    assert got[0]["year_month"] == month(1) and got[0]["is_primary_visit"] and got[0]["transaction_amount"] == Decimal("12500.00")


def test_clinics_grid_to_branches(spark):
    from ledgerline.operators import conform as C
    from ledgerline.sources import grid as G
    cells = [("2025_01_CF (2).xlsx", "s", 1, 2, " NORTH "), ("2025_01_CF (2).xlsx", "s", 1, 3, "OTHER"), ("2025_01_CF (2).xlsx", "s", 3, 1, "Rent"),
             ("2025_01_CF (2).xlsx", "s", 3, 2, "0.1"), ("2025_01_CF (2).xlsx", "s", 3, 3, "7"), ("2025_01_CF (2).xlsx", "s", 4, 1, "Lab"), ("2025_01_CF (2).xlsx", "s", 4, 2, "12345678901.23"),
             ("2025_01_CF (2).xlsx", "s", 5, 1, "Zero"), ("2025_01_CF (2).xlsx", "s", 5, 2, "0"), ("nothing.xlsx", "s", 1, 2, "NORTH"), ("nothing.xlsx", "s", 3, 1, "Rent"), ("nothing.xlsx", "s", 3, 2, "5")]
    grid = G.grid_unpivot_clinics(spark.createDataFrame(cells, "source_file string, sheet string, row_idx int, col_idx int, value string"), ["NORTH", "OTHER"])
    assert grid.schema["amount"].dataType.simpleString() == "decimal(15,2)"
    branches = spark.createDataFrame([(3, "north", 1)], "branch_id int, code string, legal_entity_id int")
    aliases = spark.createDataFrame([("NORTH", "north")], "alias string, code string")
    got = {tuple(r[c] for c in ("year_month", "legal_entity_id", "branch_id", "line_item", "amount")) for r in C.cf_clinics_conform(grid, aliases, branches).collect()}
    assert got == {(month(1), 1, 3, "Rent", Decimal("0.10")), (month(1), 1, 3, "Lab", Decimal("12345678901.23"))}
