"""Report operators over the marts (AGG-7..28, WIN-*, TOP-*, SET-3).

Inputs are the mart frames (``monthly_pnl``, ``doctor_kpi``,
``branch_comparison``, ``service_economics``) or the cash-flow line frame
(``year_month, branch_id, branch_name?, cf_group, line_item, direction,
amount``). All global windows (ranking, running balance, shares) run on
already-aggregated frames whose size is bounded by months x branches or by
distinct line items — never on fact rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import vocab
from ._agg import psum, dmean, fmean, ratio, r6

PNL_METRICS = ["gross_revenue", "refunds", "revenue_accrual", "materials", "lab", "gross_margin",
               "payroll_doctors", "payroll_assistants", "total_payroll_direct", "rent",
               "marketing", "it_costs", "ebitda"]


# ---------------------------------------------------------------- totals ----
def totals(pnl: DataFrame, metrics=PNL_METRICS) -> DataFrame:
    """AGG-7: grand totals over the (filtered) P&L, one row."""
    return pnl.agg(*[psum(m).alias(m) for m in metrics])


def monthly_total(pnl: DataFrame, metrics=PNL_METRICS) -> DataFrame:
    """AGG-8: totals per month across branches, with margin percentages."""
    g = pnl.groupBy("year_month").agg(*[psum(m).alias(m) for m in metrics])
    if "ebitda" in metrics and "revenue_accrual" in metrics:
        g = g.withColumn("ebitda_margin", ratio("ebitda", "revenue_accrual", 100.0))
    if "gross_margin" in metrics and "revenue_accrual" in metrics:
        g = g.withColumn("gross_margin_pct", ratio("gross_margin", "revenue_accrual", 100.0))
    return g


def branch_summary(pnl: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    """AGG-9 / PRJ-3: per-branch totals over the period.

    ``avg_ticket`` is the mean of monthly means and ``unique_patients`` the sum
    of monthly distinct counts (source semantics, both non-additive); the
    payment-weighted ticket is given as ``weighted_ticket`` and, when the fact
    (already filtered to the same period) is passed, the true number of
    distinct patients over the period as ``distinct_patients``."""
    g = pnl.groupBy("branch_name").agg(
        psum("revenue_accrual").alias("revenue_accrual"), psum("ebitda").alias("ebitda"),
        fmean("avg_ticket").alias("avg_ticket"), psum("unique_patients").alias("unique_patients"),
        psum("primary_visits").alias("primary_visits"), psum("materials").alias("materials"),
        psum("total_payroll_direct").alias("total_payroll_direct"),
        psum("gross_revenue").alias("_gross"), psum("payment_count").alias("_n"))
    out = g.select(
        "branch_name", "revenue_accrual", "ebitda", "avg_ticket", "unique_patients",
        "primary_visits", "materials", "total_payroll_direct",
        r6(ratio("ebitda", "revenue_accrual")).alias("ebitda_margin"),
        r6(ratio(F.col("materials") + F.col("total_payroll_direct"), "revenue_accrual")).alias("cost_ratio"),
        r6(ratio("primary_visits", "unique_patients")).alias("primary_share"),
        r6(ratio("_gross", "_n")).alias("weighted_ticket"))
    if fact is not None:
        names = pnl.select("branch_id", "branch_name").distinct()
        d = (fact.groupBy("branch_id").agg(F.count_distinct("patient_hash").alias("distinct_patients"))
             .join(names, "branch_id", "inner").groupBy("branch_name")
             .agg(F.sum("distinct_patients").alias("distinct_patients")))
        out = out.join(d, "branch_name", "left")
    return out


def branch_month_series(pnl: DataFrame, metric: str = "revenue_accrual") -> DataFrame:
    """PRJ-4: month x branch series in time order."""
    return pnl.select("year_month", "branch_id", "branch_name", metric).orderBy("year_month", "branch_id")


def ebitda_margin_branch(pnl: DataFrame) -> DataFrame:
    """AGG-28: EBITDA margin (%) per branch, ascending."""
    g = pnl.groupBy("branch_name").agg(psum("revenue_accrual").alias("revenue_accrual"),
                                       psum("ebitda").alias("ebitda"))
    return (g.withColumn("ebitda_margin", r6(ratio("ebitda", "revenue_accrual", 100.0)))
            .orderBy(F.col("ebitda_margin").asc_nulls_first(), "branch_name"))


def revenue_share(pnl: DataFrame) -> DataFrame:
    """AGG-19: each branch's share of revenue (window over the branch aggregate)."""
    g = pnl.groupBy("branch_name").agg(psum("revenue_accrual").alias("revenue_accrual"))
    total = F.sum("revenue_accrual").over(Window.partitionBy())
    return (g.withColumn("share", r6(ratio(F.col("revenue_accrual"), total)))
            .orderBy(F.desc("revenue_accrual"), "branch_name"))


def child_adult(bc: DataFrame) -> DataFrame:
    """AGG-18: children vs adult revenue per branch (branch_comparison mart)."""
    return bc.groupBy("branch_name").agg(psum("children_revenue").alias("children_revenue"),
                                         psum("adult_revenue").alias("adult_revenue"))


# --------------------------------------------------------------- windows ----
def _branch_agg(pnl: DataFrame) -> DataFrame:
    return pnl.groupBy("branch_name").agg(
        psum("revenue_accrual").alias("revenue_accrual"), psum("ebitda").alias("ebitda"),
        psum("unique_patients").alias("unique_patients"), fmean("avg_ticket").alias("avg_ticket"),
        psum("primary_visits").alias("primary_visits"))


def branch_ranking(pnl: DataFrame) -> DataFrame:
    """WIN-3: rank branches by revenue (1..n, ties broken by name)."""
    g = _branch_agg(pnl)
    w = Window.orderBy(F.desc("revenue_accrual"), F.asc("branch_name"))
    return (g.withColumn("rank", F.row_number().over(w).cast("long"))
            .withColumn("ebitda_margin", r6(ratio("ebitda", "revenue_accrual", 100.0)))
            .select("rank", "branch_name", "revenue_accrual", "ebitda", "ebitda_margin",
                    "unique_patients", "avg_ticket", "primary_visits"))


RADAR_METRICS = ["revenue_accrual", "ebitda", "unique_patients", "avg_ticket", "primary_visits"]


def branch_radar(pnl: DataFrame, metrics=RADAR_METRICS) -> DataFrame:
    """WIN-5: per metric x / max(x) x 100, left as is when max <= 0."""
    g = _branch_agg(pnl)
    w = Window.partitionBy()
    out = [F.col("branch_name")]
    for m in metrics:
        mx = F.max(F.col(m)).over(w)
        out.append(r6(F.when(mx > 0, F.col(m).cast("double") / mx.cast("double") * F.lit(100.0))
                      .otherwise(F.col(m).cast("double"))).alias(m))
    return g.select(*out)


def kpi_mom(pnl: DataFrame) -> DataFrame:
    """WIN-2 / JN-11: per month revenue, EBITDA, ticket (mean over branches) and
    patients with the *calendar* previous month's values and % change (NULL
    when the previous month is absent or its value is 0)."""
    m = pnl.groupBy("year_month").agg(
        psum("revenue_accrual").alias("revenue"), psum("ebitda").alias("ebitda"),
        fmean("avg_ticket").alias("avg_ticket"), psum("unique_patients").alias("patients"))
    prev = m.select(F.add_months("year_month", 1).alias("year_month"),
                    *[F.col(c).alias(f"{c}_prev") for c in ("revenue", "ebitda", "avg_ticket", "patients")])
    j = m.join(prev, "year_month", "left")
    out = [F.col("year_month")]
    for c in ("revenue", "ebitda", "avg_ticket", "patients"):
        out += [F.col(c), F.col(f"{c}_prev"),
                r6((ratio(c, f"{c}_prev") - F.lit(1.0)) * F.lit(100.0)).alias(f"{c}_change_pct")]
    return j.select(*out)


def cumulative_balance(cf: DataFrame) -> DataFrame:
    """WIN-1: monthly signed net cash, then the running balance."""
    signed = F.when(F.col("direction") == F.lit("inflow"), F.col("amount")).otherwise(-F.col("amount"))
    m = cf.groupBy("year_month").agg(F.sum(signed).alias("net"))
    w = Window.orderBy("year_month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.withColumn("balance", F.sum("net").over(w))


def ticket_series(pnl: DataFrame, ma_months: int = 3) -> DataFrame:
    """WIN-7: per-branch monthly ticket in time order, with the value of the month
    before and a trailing moving average. Frames are ranges of the month's number,
    so a month that is missing has no value: it is neither skipped over nor counted."""
    number = F.year("year_month") * 12 + F.month("year_month")
    w = Window.partitionBy("branch_id").orderBy(number)
    return pnl.select(
        "branch_id", "branch_name", "year_month", "avg_ticket",
        F.max("avg_ticket").over(w.rangeBetween(-1, -1)).alias("prev_ticket"),
        r6(F.avg("avg_ticket").over(w.rangeBetween(-(ma_months - 1), 0))).alias("ticket_ma"))


# ------------------------------------------------------------- cash flow ----
def cashflow_kpis(cf: DataFrame) -> DataFrame:
    """AGG-17: inflow, outflow, net, net / inflow (%)."""
    inflow = psum(F.when(F.col("direction") == "inflow", F.col("amount")))
    outflow = psum(F.when(F.col("direction") == "outflow", F.col("amount")))
    g = cf.agg(inflow.alias("inflow"), outflow.alias("outflow"))
    return g.select("inflow", "outflow", (F.col("inflow") - F.col("outflow")).alias("net"),
                    r6(ratio(F.col("inflow") - F.col("outflow"), "inflow", 100.0)).alias("net_pct"))


def cashflow_statement(cf: DataFrame) -> DataFrame:
    """AGG-16: group subtotal rows + item rows with inflow / outflow / net, in
    one pass with GROUPING SETS ((group, item, direction), (group))."""
    inflow = F.sum(F.when(F.col("direction") == "inflow", F.col("amount")))
    outflow = F.sum(F.when(F.col("direction") == "outflow", F.col("amount")))
    g = cf.groupingSets([["cf_group", "line_item", "direction"], ["cf_group"]],
                        "cf_group", "line_item", "direction").agg(
        inflow.alias("inflow"), outflow.alias("outflow"),
        F.grouping_id().alias("_gid"), F.sum("amount").alias("_total"))
    level = F.when(F.col("_gid") == 0, F.lit("item")).otherwise(F.lit("group"))
    net = F.coalesce(F.col("inflow"), F.lit(0)) - F.coalesce(F.col("outflow"), F.lit(0))
    return (g.select("cf_group", "line_item", "direction", level.alias("level"),
                     "inflow", "outflow", net.alias("net"), "_total")
            .orderBy("cf_group", F.col("level").desc(), "direction", F.desc("_total"), "line_item")
            .drop("_total"))


def _item_totals(cf: DataFrame) -> DataFrame:
    return cf.groupBy("line_item", "direction").agg(F.sum("amount").alias("total"))


def cashflow_bridge(cf: DataFrame, n_in: int = 3, n_out: int = 8) -> DataFrame:
    """TOP-3 / SET-3 / WIN-6: top inflow items, top outflow items (negative),
    then the net total; running level over the steps."""
    t = _item_totals(cf)
    w = Window.partitionBy("direction").orderBy(F.desc("total"), "line_item")
    ranked = t.withColumn("rk", F.row_number().over(w).cast("long")).where(
        ((F.col("direction") == "inflow") & (F.col("rk") <= n_in))
        | ((F.col("direction") == "outflow") & (F.col("rk") <= n_out)))
    steps = ranked.select(
        F.when(F.col("direction") == "inflow", F.col("rk")).otherwise(F.col("rk") + F.lit(n_in)).alias("ordinal"),
        F.col("line_item").alias("label"),
        F.when(F.col("direction") == "inflow", F.lit("absolute")).otherwise(F.lit("relative")).alias("role"),
        F.when(F.col("direction") == "inflow", F.col("total")).otherwise(-F.col("total")).alias("value"))
    k = cashflow_kpis(cf)
    net = k.select(F.lit(n_in + n_out + 1).cast("long").alias("ordinal"), F.lit("net").alias("label"),
                   F.lit("total").alias("role"), F.col("net").alias("value"))
    out = steps.unionByName(net)
    w2 = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(F.when(F.col("role") != "total", F.col("value")).otherwise(F.lit(0))).over(w2)
    return out.withColumn("level", F.when(F.col("role") == "total", F.col("value")).otherwise(running))


def top_expenses(cf: DataFrame, n: int = 8) -> DataFrame:
    """TOP-2: the n largest outflow items."""
    t = cf.where(F.col("direction") == "outflow").groupBy("line_item").agg(F.sum("amount").alias("amount"))
    return t.orderBy(F.desc("amount"), "line_item").limit(n)


def top_items_by_month(cf: DataFrame, n: int = 6) -> DataFrame:
    """AGG-27 / JN-10: monthly outflows of the n largest items (semi-join)."""
    out = cf.where(F.col("direction") == "outflow")
    top = top_expenses(cf, n).select("line_item")
    return (out.join(top, "line_item", "left_semi")
            .groupBy("year_month", "line_item").agg(F.sum("amount").alias("total")))


# ----------------------------------------------------------- P&L reports ----
def pnl_statement(pnl: DataFrame, last_n: int = 6, lines=vocab.PNL_LINES) -> DataFrame:
    """AGG-20: statement lines x the last ``last_n`` months (``m1`` oldest ..
    ``m{n}`` latest; labels in ``label_m*``) + a total over *all* months of the
    input (source semantics). Months are ranked on the monthly aggregate."""
    metrics = [m for _, _, m in lines]
    mt = monthly_total(pnl, metrics)
    w = Window.orderBy(F.desc("year_month"))
    recent = mt.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= last_n)
    slots = F.max("_rk").over(Window.partitionBy())
    recent = recent.withColumn("slot", slots - F.col("_rk") + F.lit(1))
    stack = ", ".join(f"{o}, '{lbl}', CAST(`{m}` AS DECIMAL(38,2))" for o, lbl, m in lines)
    long = recent.selectExpr("slot", f"stack({len(lines)}, {stack}) as (line_no, line, value)")
    wide = long.groupBy("line_no", "line").pivot("slot", list(range(1, last_n + 1))).agg(F.first("value"))
    for i in range(1, last_n + 1):
        wide = wide.withColumnRenamed(str(i), f"m{i}")
    tot = totals(pnl, metrics).selectExpr(f"stack({len(lines)}, {stack}) as (line_no, line, total)")
    return wide.join(tot.drop("line"), "line_no", "left").orderBy("line_no")


def ebitda_bridge(pnl: DataFrame, steps=vocab.EBITDA_BRIDGE) -> DataFrame:
    """AGG-21 / WIN-6: revenue -> EBITDA waterfall with the running level."""
    metrics = list(dict.fromkeys(m for _, _, m, _, _ in steps))
    t = totals(pnl, metrics)
    stack = ", ".join(f"{o}, '{lbl}', '{role}', CAST({s} * `{m}` AS DECIMAL(38,2))" for o, lbl, m, s, role in steps)
    long = t.selectExpr(f"stack({len(steps)}, {stack}) as (ordinal, step, role, value)")
    w = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(F.when(F.col("role") != "total", F.col("value")).otherwise(F.lit(0))).over(w)
    return long.withColumn("level", F.when(F.col("role") == "total", F.col("value")).otherwise(running))


def yoy(pnl: DataFrame, year_base: int, year_cur: int, metrics=vocab.YOY_METRICS) -> DataFrame:
    """AGG-23 / FIL-8: per metric value in two years (sum; mean for the ticket)
    and delta % (0 when the base is 0). Both years come from one scan with
    conditional aggregates over a date-range filter."""
    import datetime as dt
    lo, hi = dt.date(min(year_base, year_cur), 1, 1), dt.date(max(year_base, year_cur), 12, 31)
    f = pnl.where((F.col("year_month") >= F.lit(lo)) & (F.col("year_month") <= F.lit(hi)))
    yr = F.year("year_month")
    aggs = []
    for _, _, m, how in metrics:
        for tag, y in (("base", year_base), ("cur", year_cur)):
            v = F.when(yr == F.lit(y), F.col(m))
            aggs.append((fmean(v) if how == "mean" else psum(v).cast("double")).alias(f"{m}__{tag}"))
    g = f.agg(*aggs)
    stack = ", ".join(f"{o}, '{lbl}', '{m}', `{m}__base`, `{m}__cur`" for o, lbl, m, _ in metrics)
    long = g.selectExpr(f"stack({len(metrics)}, {stack}) as (ordinal, label, metric, value_base, value_cur)")
    delta = F.when(F.col("value_base") == 0, F.lit(0.0)).otherwise(
        (F.col("value_cur") / F.col("value_base") - F.lit(1.0)) * F.lit(100.0))
    return long.withColumn("delta_pct", r6(delta)).withColumn("year_base", F.lit(year_base)) \
        .withColumn("year_cur", F.lit(year_cur))


# -------------------------------------------------------------- doctors ----
def doctor_summary(dk: DataFrame) -> DataFrame:
    """AGG-10: per doctor x specialization x branch over the period."""
    return dk.groupBy("doctor_name", "specialization", "branch_name").agg(
        psum("revenue").alias("revenue"), psum("visit_count").alias("visit_count"),
        psum("unique_patients").alias("unique_patients"), psum("primary_visits").alias("primary_visits"),
        fmean("avg_ticket").alias("avg_ticket"), fmean("revenue_per_workday").alias("revenue_per_workday"))


def top_doctors(dk: DataFrame, n: int = 15) -> DataFrame:
    """TOP-4: the n doctors with the highest revenue."""
    return doctor_summary(dk).orderBy(F.desc("revenue"), "doctor_name", "branch_name").limit(n)


def spec_summary(dk: DataFrame) -> DataFrame:
    """AGG-11: mean ticket and revenue per specialization."""
    return dk.groupBy("specialization").agg(fmean("avg_ticket").alias("avg_ticket"),
                                            psum("revenue").alias("revenue"))


def doctor_heatmap(dk: DataFrame, n: int = 15, months=None) -> DataFrame:
    """AGG-22: top-n doctors x month revenue, missing -> 0, month columns
    ``yyyy-MM`` in time order. ``months`` (explicit pivot values) avoids the
    extra distinct job; without it Spark discovers them."""
    top = top_doctors(dk, n).select("doctor_name").distinct()
    h = dk.join(top, "doctor_name", "left_semi").withColumn("month", F.date_format("year_month", "yyyy-MM"))
    piv = h.groupBy("doctor_name").pivot("month", months).agg(F.sum("revenue"))
    return piv.fillna(0)


# ------------------------------------------------------------- services ----
def service_summary(se: DataFrame) -> DataFrame:
    """AGG-12: per service totals; margin shown as a 0..100 percent."""
    return se.groupBy("service_name", "category").agg(
        psum("total_revenue").alias("total_revenue"), psum("service_count").alias("service_count"),
        r6(F.avg("margin_pct") * F.lit(100.0)).alias("margin_pct"), fmean("avg_price").alias("avg_price"))


def service_kpis(se: DataFrame, approx: bool = False) -> DataFrame:
    """AGG-13: revenue, mean margin (%), count of payments, distinct services."""
    distinct = F.approx_count_distinct("service_name") if approx else F.count_distinct("service_name")
    return se.agg(psum("total_revenue").alias("total_revenue"),
                  r6(F.avg("margin_pct") * F.lit(100.0)).alias("avg_margin_pct"),
                  psum("service_count").alias("total_services"), distinct.alias("unique_services"))


def revenue_tree(se: DataFrame) -> DataFrame:
    """AGG-14: rollup(category, service) revenue with share of the root, which is one number: no window gathers the rows."""
    g = se.rollup("category", "service_name").agg(F.sum("total_revenue").alias("total_revenue"),
                                                  F.grouping_id().alias("_gid"))
    root = se.agg(F.sum("total_revenue")).scalar()
    level = F.when(F.col("_gid") == 3, "root").when(F.col("_gid") == 1, "category").otherwise("service")
    return g.select("category", "service_name", level.alias("level"), "total_revenue",
                    r6(ratio("total_revenue", root)).alias("share_of_root"))


def category_branch(se: DataFrame) -> DataFrame:
    """AGG-15: category x branch revenue."""
    return se.groupBy("category", "branch_name").agg(psum("total_revenue").alias("total_revenue"))


def top_services(se: DataFrame, by: str = "total_revenue", n: int = 10) -> DataFrame:
    """TOP-5: top services by revenue or by margin."""
    return service_summary(se).orderBy(F.col(by).desc_nulls_last(), "service_name").limit(n)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """AGG-24: sorted distinct values of a column (filter option lists)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
