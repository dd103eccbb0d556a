"""Reports the source declares as staging tables, computed from facts (RPT-1..10).

Per-patient work (first-seen month, lifetime value) is an aggregate keyed by
the patient followed by a join of *aggregated* rows, so a patient with very
many visits contributes one row per group, never a long list to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import vocab
from ._agg import psum, ratio, r6

def _pay():
    return F.col("operation_type") == F.lit(vocab.PAYMENT)


def _amt():
    return F.col("transaction_amount")


def avg_ticket(fact: DataFrame, key: str = "branch_id") -> DataFrame:
    """RPT-1: visits (payments), revenue and revenue per visit by clinic."""
    g = fact.groupBy(key).agg(F.count(F.when(_pay(), 1)).alias("visits"), F.sum(F.when(_pay(), _amt())).alias("revenue"))
    return g.withColumn("avg_ticket", ratio("revenue", "visits"))


def ltv_procedures(fact: DataFrame) -> DataFrame:
    """RPT-2: per procedure: distinct clients, count, revenue, mean/min/max
    price, revenue and count per client (payments only)."""
    p = fact.where(_pay() & F.col("service_name").isNotNull())
    g = p.groupBy("service_name").agg(
        F.count_distinct("patient_hash").alias("clients"), F.count(F.lit(1)).alias("procedures"),
        F.sum(_amt()).alias("revenue"), F.min(_amt()).alias("min_price"), F.max(_amt()).alias("max_price"))
    return g.select("service_name", "clients", "procedures", "revenue",
                    ratio("revenue", "procedures").alias("avg_price"), "min_price", "max_price",
                    ratio("revenue", "clients").alias("revenue_per_client"),
                    r6(ratio("procedures", "clients")).alias("procedures_per_client"))


def top_services_per_branch(fact: DataFrame, n: int = 10) -> DataFrame:
    """RPT-3: top-n services per clinic by paid total (window per branch over
    the branch x service aggregate)."""
    g = fact.where(_pay()).groupBy("branch_id", "service_name").agg(
        F.count(F.lit(1)).alias("quantity"), F.sum(_amt()).alias("total"))
    w = Window.partitionBy("branch_id").orderBy(F.desc("total"), F.asc("service_name"))
    return (g.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
            .withColumn("price", ratio("total", "quantity"))
            .select("branch_id", "rank", "service_name", "price", "quantity", "total"))


def yoy_lines(lines: DataFrame, year_base: int, year_cur: int, key: str = "line_item",
              date_col: str = "year_month", amount: str = "amount") -> DataFrame:
    """RPT-4: per line amounts in two years, share of each year's total,
    absolute and relative delta, share delta (percentage points)."""
    import datetime as dt
    f = lines.where((F.col(date_col) >= F.lit(dt.date(min(year_base, year_cur), 1, 1)))
                    & (F.col(date_col) <= F.lit(dt.date(max(year_base, year_cur), 12, 31))))
    yr = F.year(date_col)
    g = f.groupBy(key).agg(psum(F.when(yr == year_base, F.col(amount))).alias("amount_base"),
                           psum(F.when(yr == year_cur, F.col(amount))).alias("amount_cur"))
    sb = ratio("amount_base", g.agg(F.sum("amount_base")).scalar())   # one number each: no window gathers the lines
    sc = ratio("amount_cur", g.agg(F.sum("amount_cur")).scalar())
    return g.select(key, "amount_base", "amount_cur", r6(sb).alias("share_base"), r6(sc).alias("share_cur"),
                    (F.col("amount_cur") - F.col("amount_base")).alias("delta"),
                    r6((ratio("amount_cur", "amount_base") - F.lit(1.0)) * F.lit(100.0)).alias("delta_pct"),
                    r6((sc - sb) * F.lit(100.0)).alias("share_delta_pp"))


def supplier_turnover(ledger: DataFrame, start, end) -> DataFrame:
    """RPT-5: opening / turnover / closing balances by account and counterparty.
    ``ledger``: entry_date, account, counterparty, side ('debit'|'credit'), amount."""
    before = F.col("entry_date") < F.lit(start)
    within = (F.col("entry_date") >= F.lit(start)) & (F.col("entry_date") <= F.lit(end))
    deb, cred = F.col("side") == "debit", F.col("side") == "credit"
    a = F.col("amount")
    g = ledger.where(F.col("entry_date") <= F.lit(end)).groupBy("account", "counterparty").agg(
        psum(F.when(before & deb, a)).alias("opening_debit"), psum(F.when(before & cred, a)).alias("opening_credit"),
        psum(F.when(within & deb, a)).alias("turnover_debit"), psum(F.when(within & cred, a)).alias("turnover_credit"))
    return g.select("*", (F.col("opening_debit") + F.col("turnover_debit")).alias("closing_debit"),
                    (F.col("opening_credit") + F.col("turnover_credit")).alias("closing_credit"))


STATEMENT_LINES = [("2110", "revenue_accrual"), ("2120", "materials"), ("2100", "gross_margin"),
                   ("2200", "ebitda")]


def statement_lines(pnl: DataFrame, dim_branch: DataFrame, lines=STATEMENT_LINES) -> DataFrame:
    """RPT-6: per legal entity x line x year, current amount and the previous
    calendar year's (NULL where that year is missing)."""
    ent = dim_branch.select("branch_id", "legal_entity_id")
    p = pnl.join(ent, "branch_id", "left")
    g = p.groupBy("legal_entity_id", F.year("year_month").alias("year")).agg(
        *[psum(m).alias(m) for _, m in lines])
    stack = ", ".join(f"'{code}', '{m}', CAST(`{m}` AS DECIMAL(38,2))" for code, m in lines)
    long = g.selectExpr("legal_entity_id", "year", f"stack({len(lines)}, {stack}) as (line_code, line_name, amount_current)")
    w = Window.partitionBy("legal_entity_id", "line_code").orderBy("year")
    return long.select("legal_entity_id", F.make_date("year", F.lit(12), F.lit(31)).alias("period_end"),
                       "line_code", "line_name", "amount_current",
                       F.max("amount_current").over(w.rangeBetween(-1, -1)).alias("amount_previous"))


def patient_base(fact: DataFrame, by_age_group: bool = False) -> DataFrame:
    """Per (month, branch, patient), with ``by_age_group`` also child or adult: paid
    visits and revenue, with the patient's first month and lifetime value. An
    aggregate (never larger than the fact) shared by the patient reports. A patient's
    months are put together (one entry per month and branch) and their lifetime is
    summed from them, so the fact is scanned once and nothing is joined back."""
    keys = ["year_month", "branch_id", *(["is_child"] if by_age_group else []), "patient_hash"]
    each = (fact.where(F.col("patient_hash").isNotNull()).groupBy(*keys)
            .agg(F.count(F.when(_pay(), 1)).alias("visits"), F.sum(F.when(_pay(), _amt())).alias("revenue")))
    held = [c for c in each.columns if c != "patient_hash"]
    lives = each.groupBy("patient_hash").agg(F.min("year_month").alias("first_month"), F.sum("revenue").alias("ltv"),
                                             F.collect_list(F.struct(*held)).alias("_each"))
    return lives.select("patient_hash", "first_month", "ltv", F.inline("_each")).select("patient_hash", *held, "first_month", "ltv")


AGE_BUCKETS = [("0_17", None, 17), ("18_30", 18, 30), ("31_45", 31, 45), ("46_60", 46, 60), ("60_plus", 61, None)]


def patient_report(base: DataFrame, ages: DataFrame, date_from, date_to, group_by=("month", "branch"), branch_id=None,
                   age_group: str | None = None) -> DataFrame:
    """RPT-7 for a period: the months from ``date_from`` to ``date_to``, optionally of one branch or one age group (``adult`` or
    ``child``), grouped by any of ``month``, ``branch`` and ``age_group``, or by none (one row).

    ``base`` is ``patient_base(fact, by_age_group=True)``, so no report scans the fact; ``ages`` has (patient_hash, age), one row
    a patient. A patient counts once in a group, is *new* there if the group holds their first month anywhere, and their lifetime
    value is that of all time. Patients without an age are in no age bucket and not in the mean.
    """
    names = {"month": "year_month", "branch": "branch_id", "age_group": "is_child"}
    keys = [names[g] for g in group_by]
    rows = base.where(F.col("year_month").between(F.trunc(F.lit(date_from).cast("date"), "month"), F.lit(date_to).cast("date")))
    if branch_id is not None:
        rows = rows.where(F.col("branch_id") == branch_id)
    if age_group is not None:
        rows = rows.where(F.col("is_child") == (age_group == "child"))
    each = rows.groupBy(*keys, "patient_hash").agg(
        F.sum("visits").alias("v"), F.sum("revenue").alias("r"), F.max("ltv").alias("l"), F.max((F.col("year_month") == F.col("first_month"))).alias("new"))
    each = each.join(ages.select("patient_hash", "age"), "patient_hash", "left")
    inside = lambda lo, hi: (F.col("age") >= lo if lo is not None else F.lit(True)) & (F.col("age") <= hi if hi is not None else F.lit(True))
    g = each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_patients"), F.count_if("new").alias("new_patients"), F.sum("v").alias("_v"), F.sum("r").alias("_r"),
        F.sum("l").alias("_l"), F.count("l").alias("_nl"), F.avg("age").alias("avg_age"),
        *[F.count_if(F.col("age").isNotNull() & inside(lo, hi)).alias(f"age_{name}") for name, lo, hi in AGE_BUCKETS])
    back = F.col("total_patients") - F.col("new_patients")
    group = [F.when(F.col(k), "child").when(~F.col(k), "adult").alias("age_group") if k == "is_child" else F.col(k) for k in keys]
    return g.select(*group, "total_patients", "new_patients", back.alias("returning_patients"), r6(ratio(back, "total_patients")).alias("retention_rate"),
                    r6(F.col("avg_age")).alias("avg_age"), *[f"age_{name}" for name, _, _ in AGE_BUCKETS],
                    r6(ratio("_v", "total_patients")).alias("avg_visits_per_patient"), ratio("_r", "total_patients").alias("avg_revenue_per_patient"),
                    ratio("_l", "_nl").alias("avg_ltv"))


def patient_stats(fact: DataFrame | None = None, keys=("year_month", "branch_id"), age_col: str | None = None,
                  base: DataFrame | None = None) -> DataFrame:
    """RPT-7: total / new / returning patients per group, retention, visits
    and revenue per patient, mean lifetime value. A patient is *new* in a group
    that holds their first month anywhere, whatever the keys. ``base`` (``patient_base``)
    can be passed for the default month x branch keys."""
    keys = list(keys)
    if base is not None and keys == ["year_month", "branch_id"] and not age_col:
        j = base.withColumn("_first_here", F.col("year_month"))
    else:
        pat = fact.where(F.col("patient_hash").isNotNull())
        first = pat.groupBy("patient_hash").agg(F.min("year_month").alias("first_month"),
                                                F.sum(F.when(_pay(), _amt())).alias("ltv"))
        aggs = [F.count(F.when(_pay(), 1)).alias("visits"), F.sum(F.when(_pay(), _amt())).alias("revenue"),
                F.min("year_month").alias("_first_here")]
        if age_col:
            aggs.append(F.max(age_col).alias("age"))
        pg = pat.groupBy(*keys, "patient_hash").agg(*aggs)
        j = pg.join(first, "patient_hash", "inner")
    new = F.col("first_month") == F.col("_first_here")
    out = [F.count(F.lit(1)).alias("total_patients"), F.count(F.when(new, 1)).alias("new_patients"),
           F.sum("visits").alias("_v"), F.sum("revenue").alias("_r"),
           F.sum("ltv").alias("_l"), F.count("ltv").alias("_nl")]
    if age_col:
        a = F.col("age")
        out += [F.avg(a).alias("avg_age"),
                F.count_if(a < 18).alias("age_0_17"), F.count_if(a.between(18, 30)).alias("age_18_30"),
                F.count_if(a.between(31, 45)).alias("age_31_45"), F.count_if(a.between(46, 60)).alias("age_46_60"),
                F.count_if(a > 60).alias("age_60_plus")]
    g = j.groupBy(*keys).agg(*out)
    ret = F.col("total_patients") - F.col("new_patients")
    cols = [*keys, "total_patients", "new_patients", ret.alias("returning_patients"),
            r6(ratio(ret, "total_patients")).alias("retention_rate"),
            r6(ratio("_v", "total_patients")).alias("avg_visits_per_patient"),
            ratio("_r", "total_patients").alias("avg_revenue_per_patient"),
            ratio("_l", "_nl").alias("avg_ltv")]
    if age_col:
        cols += ["avg_age", "age_0_17", "age_18_30", "age_31_45", "age_46_60", "age_60_plus"]
    return g.select(*cols)


def leads_monthly(leads: DataFrame, pnl: DataFrame) -> DataFrame:
    """RPT-8: monthly leads by type, next to the month's primary visits and the
    primary-lead conversion. ``leads``: year_month, lead_type, count."""
    g = leads.groupBy("year_month", "lead_type").agg(F.sum("count").alias("leads"))
    pv = pnl.groupBy("year_month").agg(psum("primary_visits").alias("primary_visits"))
    j = g.join(pv, "year_month", "left")
    return j.withColumn("conversion", r6(ratio("primary_visits", "leads")))


def appointment_outcomes(appts: DataFrame, keys=("branch_id",)) -> DataFrame:
    """RPT-9: completed / cancelled / no-show shares per group."""
    st = F.col("status")
    g = appts.groupBy(*keys).agg(F.count(F.lit(1)).alias("appointments"),
                                 F.count_if(st == "completed").alias("completed"),
                                 F.count_if(st == "cancelled").alias("cancelled"),
                                 F.count_if(st == "no_show").alias("no_show"))
    return g.select("*", r6(ratio("completed", "appointments")).alias("completed_share"),
                    r6(ratio("cancelled", "appointments")).alias("cancelled_share"),
                    r6(ratio("no_show", "appointments")).alias("no_show_share"))


def receivables(items: DataFrame, keys=("branch_id", "status")) -> DataFrame:
    """RPT-10: subtotal, discounts, total, paid and debt per group.
    ``items``: keys, subtotal, discount_amount, paid (bool)."""
    total = F.col("subtotal") - F.col("discount_amount")
    g = items.groupBy(*keys).agg(F.sum("subtotal").alias("subtotal"), F.sum("discount_amount").alias("discount_total"),
                                 F.sum(total).alias("total_amount"),
                                 psum(F.when(F.col("paid"), total)).alias("paid_amount"),
                                 F.count(F.lit(1)).alias("invoices"))
    return g.withColumn("debt", F.col("total_amount") - F.col("paid_amount"))


def patient_stats_sets(fact: DataFrame | None = None, sets=(("year_month", "branch_id"), ("year_month",), ("branch_id",), ()),
                       base: DataFrame | None = None) -> DataFrame:
    """RPT-7 with combinable keys (GROUPING SETS over month and branch).

    Step 1: grouping sets with the patient appended give one row per
    (set keys, patient) — visits, revenue, lifetime value, and whether the
    patient's first month is in the group (for sets without the month: the
    patient's first month had activity in the group). Step 2 counts those rows
    per set, so patients are counted once per group and the mean lifetime
    value is over distinct patients. ``level`` names the keys of the set."""
    base = (patient_base(fact) if base is None else base) \
        .withColumn("is_new", (F.col("first_month") == F.col("year_month")).cast("int"))
    gsets = [list(s) + ["patient_hash"] for s in sets]
    per = base.groupingSets(gsets, "year_month", "branch_id", "patient_hash").agg(
        F.sum("visits").alias("visits"), F.sum("revenue").alias("revenue"), F.max("ltv").alias("ltv"),
        F.max("is_new").alias("is_new"), F.grouping("year_month").alias("g_ym"),
        F.grouping("branch_id").alias("g_br"))
    g = per.groupBy("g_ym", "g_br", "year_month", "branch_id").agg(
        F.count(F.lit(1)).alias("total_patients"), F.sum("is_new").cast("long").alias("new_patients"),
        F.sum("visits").alias("_v"), F.sum("revenue").alias("_r"), F.sum("ltv").alias("_l"), F.count("ltv").alias("_nl"))
    level = (F.when((F.col("g_ym") == 0) & (F.col("g_br") == 0), "year_month,branch_id")
             .when(F.col("g_ym") == 0, "year_month").when(F.col("g_br") == 0, "branch_id").otherwise("all"))
    ret = F.col("total_patients") - F.col("new_patients")
    return g.select(level.alias("level"), "year_month", "branch_id", "total_patients", "new_patients",
                    ret.alias("returning_patients"), r6(ratio(ret, "total_patients")).alias("retention_rate"),
                    r6(ratio("_v", "total_patients")).alias("avg_visits_per_patient"),
                    ratio("_r", "total_patients").alias("avg_revenue_per_patient"),
                    ratio("_l", "_nl").alias("avg_ltv"))
