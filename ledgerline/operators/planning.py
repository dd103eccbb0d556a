"""Planning operators (PLN-1..7) over the monthly P&L mart.

Everything runs on the monthly aggregate (one row per month, bounded by the
calendar): the forecast horizon is generated from the one-row trailing
average with ``explode(sequence(...))`` — no join to a made-up calendar and no
cross join. Seasonality is a 12-entry literal map.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window, functions as F

from .. import vocab
from ._agg import psum, ratio, r6


def growth_factors(annual_growth_pct: float, horizon: int) -> list[float]:
    """Compounded monthly growth per forecast step i=1..horizon."""
    g = (1 + annual_growth_pct / 100) ** (1 / 12)
    return [g ** (i + 1) for i in range(horizon)]


def _season_map(seasonality: dict):
    kv = []
    for m in range(1, 13):
        kv += [F.lit(m), F.lit(float(seasonality.get(m, 1.0)))]
    return F.create_map(*kv)


def monthly_series(pnl: DataFrame) -> DataFrame:
    return pnl.groupBy("year_month").agg(psum("revenue_accrual").alias("revenue"),
                                         psum("ebitda").alias("ebitda"))


def forecast(pnl: DataFrame, horizon: int = 6, growth_pct: float = 12.0, optimistic_pct: float = 10.0,
             pessimistic_pct: float = -10.0, seasonality: dict | None = None, trailing: int = 12,
             default_ebitda_ratio: float = 0.15) -> DataFrame:
    """PLN-1/2: mean of the last ``trailing`` months x seasonality[month] x
    compounded monthly growth, with optimistic/pessimistic scenarios; EBITDA =
    revenue x trailing EBITDA ratio (``default_ebitda_ratio`` without revenue)."""
    seasonality = seasonality or vocab.SEASONALITY
    m = monthly_series(pnl)
    w = Window.orderBy(F.desc("year_month"))
    last = m.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= trailing)
    base = last.agg(F.max("year_month").alias("last_month"),
                    F.try_divide(F.sum("revenue").cast("double"), F.count("revenue").cast("double")).alias("avg_rev"),
                    F.try_divide(F.sum("ebitda").cast("double"), F.count("ebitda").cast("double")).alias("avg_ebitda"))
    gf = F.array(*[F.lit(x) for x in growth_factors(growth_pct, horizon)])
    steps = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    ym = F.add_months("last_month", F.col("step"))
    rev = F.col("avg_rev") * F.element_at(_season_map(seasonality), F.month(ym)) * F.element_at(gf, F.col("step"))
    er = F.when((F.col("avg_rev") != 0) & F.col("avg_rev").isNotNull(), F.col("avg_ebitda") / F.col("avg_rev")) \
        .otherwise(F.lit(default_ebitda_ratio))
    up, dn = 1 + optimistic_pct / 100, 1 + pessimistic_pct / 100
    f = steps.select(ym.alias("year_month"), F.col("step").cast("long").alias("step"), rev.alias("revenue_base"),
                     er.alias("_er"))
    return f.select(
        "year_month", "step", "revenue_base",
        (F.col("revenue_base") * F.lit(up)).alias("revenue_optimistic"),
        (F.col("revenue_base") * F.lit(dn)).alias("revenue_pessimistic"),
        (F.col("revenue_base") * F.col("_er")).alias("ebitda_base"),
        (F.col("revenue_base") * F.lit(up) * F.col("_er")).alias("ebitda_optimistic"),
        (F.col("revenue_base") * F.lit(dn) * F.col("_er")).alias("ebitda_pessimistic"),
        r6(F.col("_er") * F.lit(100.0)).alias("ebitda_margin"))


def forecast_kpis(pnl: DataFrame, horizon: int = 6, **kw) -> DataFrame:
    """PLN-3: forecast totals, annualised revenue, margin, historical total."""
    fc = forecast(pnl, horizon, **kw).select(
        F.col("revenue_base").alias("fc_revenue"), F.col("ebitda_base").alias("fc_ebitda"),
        F.lit(None).cast("decimal(38,2)").alias("hist_revenue"))
    hist = monthly_series(pnl).select(
        F.lit(None).cast("double").alias("fc_revenue"), F.lit(None).cast("double").alias("fc_ebitda"),
        F.col("revenue").cast("decimal(38,2)").alias("hist_revenue"))
    # one aggregate over both inputs (no join between the two single rows)
    t = fc.unionByName(hist).agg(F.sum("fc_revenue").alias("fc_revenue"), F.sum("fc_ebitda").alias("fc_ebitda"),
                                 F.sum("hist_revenue").alias("hist_revenue"))
    return t.select(F.round("fc_revenue", 2).alias("fc_revenue"), F.round("fc_ebitda", 2).alias("fc_ebitda"),
                    F.round(F.col("fc_revenue") / F.lit(float(horizon)) * F.lit(12.0), 2).alias("annual_forecast"),
                    r6(ratio("fc_ebitda", "fc_revenue", 100.0)).alias("fc_margin_pct"),
                    "hist_revenue")


def fact_plus_forecast(pnl: DataFrame, horizon: int = 6, **kw) -> DataFrame:
    """SET-3: actual monthly totals and forecast on one time axis (``kind``)."""
    a = monthly_series(pnl).select(
        "year_month", F.lit("actual").alias("kind"), F.col("revenue").cast("double").alias("revenue"),
        F.col("ebitda").cast("double").alias("ebitda"),
        F.lit(None).cast("double").alias("revenue_optimistic"), F.lit(None).cast("double").alias("revenue_pessimistic"))
    f = forecast(pnl, horizon, **kw).select(
        "year_month", F.lit("forecast").alias("kind"), F.col("revenue_base").alias("revenue"),
        F.col("ebitda_base").alias("ebitda"), "revenue_optimistic", "revenue_pessimistic")
    return a.unionByName(f)


def gap_analysis(pnl: DataFrame, year_fact: int, growth_pct: float = 12.0) -> DataFrame:
    """PLN-4: plan = previous year x (1+g) scaled by months elapsed in the fact
    year; gap absolute and % for revenue and EBITDA, branches in both years."""
    y0 = year_fact - 1
    f = pnl.where((F.col("year_month") >= F.lit(_dt.date(y0, 1, 1)))
                  & (F.col("year_month") <= F.lit(_dt.date(year_fact, 12, 31))))
    yr = F.year("year_month")
    cur, prev = yr == F.lit(year_fact), yr == F.lit(y0)
    g = f.groupBy("branch_name").agg(
        psum(F.when(cur, F.col("revenue_accrual"))).alias("revenue_fact"),
        psum(F.when(cur, F.col("ebitda"))).alias("ebitda_fact"),
        psum(F.when(prev, F.col("revenue_accrual"))).alias("_rev0"),
        psum(F.when(prev, F.col("ebitda"))).alias("_eb0"),
        F.count(F.when(cur, 1)).alias("_n1"), F.count(F.when(prev, 1)).alias("_n0"),
        F.max(F.when(cur, F.month("year_month"))).alias("_mmax"))
    months = F.max("_mmax").over(Window.partitionBy())
    g = g.withColumn("months_passed", months).where((F.col("_n1") > 0) & (F.col("_n0") > 0))
    k = 1 + growth_pct / 100
    out = g.select(
        "branch_name", "months_passed",
        F.col("revenue_fact").cast("double").alias("revenue_fact"),
        (F.col("_rev0").cast("double") * F.lit(k) * F.col("months_passed") / F.lit(12)).alias("revenue_plan_ytd"),
        F.col("ebitda_fact").cast("double").alias("ebitda_fact"),
        (F.col("_eb0").cast("double") * F.lit(k) * F.col("months_passed") / F.lit(12)).alias("ebitda_plan_ytd"))
    return out.select(
        "*", (F.col("revenue_fact") - F.col("revenue_plan_ytd")).alias("revenue_gap"),
        (F.col("ebitda_fact") - F.col("ebitda_plan_ytd")).alias("ebitda_gap")).select(
        "*", r6(ratio("revenue_gap", "revenue_plan_ytd", 100.0)).alias("revenue_gap_pct"),
        r6(ratio("ebitda_gap", "ebitda_plan_ytd", 100.0)).alias("ebitda_gap_pct"))


def breakeven(pnl: DataFrame, bands=(20.0, 40.0), labels=("red", "amber", "green")) -> DataFrame:
    """PLN-5/6: per branch monthly means; fixed = rent + IT, variable =
    materials + lab + payroll + marketing; contribution margin, break-even
    revenue and patients (half-even rounding), safety margin % and its band."""
    def mean(c):
        return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))
    cols = ["revenue_accrual", "materials", "lab", "payroll_doctors", "payroll_assistants",
            "rent", "marketing", "it_costs"]
    g = pnl.groupBy("branch_name").agg(*[mean(c).alias(c) for c in cols], F.avg("avg_ticket").alias("_ticket"))
    fixed = F.col("rent") + F.col("it_costs")
    var = F.col("materials") + F.col("lab") + F.col("payroll_doctors") + F.col("payroll_assistants") + F.col("marketing")
    g = g.select("branch_name", "revenue_accrual", "_ticket", fixed.alias("fixed_costs"), var.alias("variable_costs"))
    g = g.withColumn("variable_pct", F.try_divide(F.col("variable_costs"), F.col("revenue_accrual")))
    g = g.withColumn("contribution_margin", F.lit(1.0) - F.col("variable_pct"))
    g = g.withColumn("breakeven_revenue", F.try_divide(F.col("fixed_costs"), F.col("contribution_margin")))
    g = g.withColumn("breakeven_patients", F.bround(F.try_divide(F.col("breakeven_revenue"), F.col("_ticket")), 0))
    g = g.withColumn("safety_margin", F.try_divide(F.col("revenue_accrual") - F.col("breakeven_revenue"),
                                                   F.col("revenue_accrual")) * F.lit(100.0))
    sm = F.col("safety_margin")
    band = F.when(sm < bands[0], labels[0]).when(sm < bands[1], labels[1]).when(sm.isNotNull(), labels[2])
    return g.select("branch_name", r6("revenue_accrual").alias("avg_revenue"), r6("fixed_costs").alias("fixed_costs"),
                    r6("variable_costs").alias("variable_costs"), r6("variable_pct").alias("variable_pct"),
                    r6("contribution_margin").alias("contribution_margin"),
                    r6("breakeven_revenue").alias("breakeven_revenue"), "breakeven_patients",
                    r6("safety_margin").alias("safety_margin"), band.alias("safety_band"))


def seasonality_index(pnl: DataFrame, seasonality: dict | None = None) -> DataFrame:
    """PLN-7: fitted factor per calendar month (month mean / overall monthly
    mean) next to the configured factor."""
    seasonality = seasonality or vocab.SEASONALITY
    m = monthly_series(pnl).groupBy(F.month("year_month").alias("month_num")).agg(
        F.sum("revenue").alias("_s"), F.count("revenue").alias("_n"))
    w = Window.partitionBy()
    overall = F.sum("_s").over(w).cast("double") / F.sum("_n").over(w).cast("double")
    return m.select("month_num", F.col("_n").alias("n_months"),
                    r6((F.col("_s").cast("double") / F.col("_n").cast("double")) / overall).alias("fitted_factor"),
                    F.element_at(_season_map(seasonality), F.col("month_num")).alias("configured_factor"))
