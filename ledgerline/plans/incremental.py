"""Incremental / streaming operators (INC-*, WIN-8) as registered queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..snapshots import HighWaterMarks, Snapshot, refresh_parts
from ..sources.driver import Warehouse, read
from ..streaming import endpoints as E, incremental as I
from . import sqlbase as S
from .registry import finish, query

HWM = dt.datetime(2024, 1, 15, 0, 0, 0)
LATEST_SQL = """SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
DAILY_SQL = """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
  event_type, COUNT(*) AS events, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value_sum FROM events GROUP BY 1, 2, 3"""


@query("incremental_filter", f"SELECT * FROM events WHERE ts >= TIMESTAMP '{HWM.isoformat(sep=' ')}'")
def incremental_filter(spark, sf_dir):
    return I.incremental_filter(read(spark, sf_dir, "events"), HWM, "ts")


@query("latest_per_key", LATEST_SQL)
def latest_per_key(spark, sf_dir):
    return I.latest_per_key(read(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("events_daily", DAILY_SQL)
def events_daily(spark, sf_dir):
    return I.events_daily(read(spark, sf_dir, "events"))


@query("latest_per_key_stream", LATEST_SQL)
def latest_per_key_stream(spark, sf_dir):
    """Structured Streaming ingest of the events table (as landed files) with
    a checkpoint, then latest-wins per user on read."""
    schema = read(spark, sf_dir, "events").schema
    out, ckpt = I.scratch_dirs(spark, "latest")
    I.run_to_end(I.stream_changes(spark, sf_dir, schema, out, ckpt, glob="events.parquet"))
    return I.read_latest(spark, out, "user_id", "ts", "event_id")


@query("events_daily_stream", DAILY_SQL)
def events_daily_stream(spark, sf_dir):
    """Daily totals by a stream in update mode, merged per batch: open days are there too."""
    schema = read(spark, sf_dir, "events").schema
    out, ckpt = I.scratch_dirs(spark, "daily")
    table = Snapshot.by_key(spark, out, ["window_start", "event_type"], buckets=1)
    E.stream_daily_totals(spark, sf_dir, schema, table, ckpt, glob="events.parquet")
    return table.read().drop("batch").withColumn("value_sum", F.col("value_sum").cast("double"))


# Batches of the events: by time, so that later ones change earlier users again.
FIRST, SECOND = dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 20)


@query("silver_latest", LATEST_SQL)
def silver_latest(spark, sf_dir):
    """Three batches merged into a silver table, the second delivered twice: the newest event of each user."""
    events = read(spark, sf_dir, "events")
    ts = F.col("ts")
    batches = [events.where(ts < F.lit(FIRST)), events.where((ts >= F.lit(FIRST)) & (ts < F.lit(SECOND))), events.where((ts >= F.lit(SECOND)) | ts.isNull())]
    table = Snapshot.by_key(spark, I.scratch_dirs(spark, "silver")[0], "user_id")
    for number in (0, 1, 1, 2):
        table.merge(batches[number], "user_id", "ts", "event_id", writer="events", batch=number)
    return table.read()


@query("incremental_sync", LATEST_SQL)
def incremental_sync(spark, sf_dir):
    """Loads from a stored high-water mark: one, one that fails after reading, and one that makes up for it."""
    events = read(spark, sf_dir, "events")
    out, state = I.scratch_dirs(spark, "sync")
    table, marks = Snapshot.by_key(spark, out, "user_id"), HighWaterMarks(spark, state)
    merge = lambda delta: table.merge(delta, "user_id", "ts", "event_id")

    def lost(delta):
        raise ConnectionError("lost between extract and commit")

    marks.load("events", events.where(F.col("ts") < F.lit(SECOND)), "ts", merge)
    try:
        marks.load("events", events, "ts", lost)
    except ConnectionError:
        pass
    marks.load("events", events, "ts", merge)
    return table.read()


@query("endpoint_streams", """SELECT 'events' AS endpoint, COUNT(*) AS rows, NULL::VARCHAR AS error, COUNT(DISTINCT user_id) AS kept FROM events
UNION ALL SELECT 'orders', COUNT(*), NULL, COUNT(*) FROM orders
UNION ALL SELECT 'missing', NULL, 'PATH_NOT_FOUND', NULL""")
def endpoint_streams(spark, sf_dir):
    """Three endpoints in one run, merged, appended and failing: rows taken, the error, and rows in the table after it."""
    out, ckpt = I.scratch_dirs(spark, "endpoints")
    events, orders = (read(spark, sf_dir, x).schema for x in ("events", "orders"))
    ends = [E.Endpoint("events", sf_dir, events, Snapshot.by_key(spark, f"{out}/events", "user_id"), E.MERGE, "user_id", "ts", "event_id", glob="events.parquet"),
            E.Endpoint("orders", sf_dir, orders, Snapshot.by_key(spark, f"{out}/orders", "o_orderkey"), E.APPEND, glob="orders.parquet"),
            E.Endpoint("missing", f"{sf_dir}/no-such-endpoint", orders, Snapshot.by_key(spark, f"{out}/missing", "o_orderkey"), E.APPEND)]
    ran = E.run_endpoints(spark, ends, ckpt)
    kept = None
    for e in ends[:2]:
        one = e.table.read().agg(F.lit(e.name).alias("endpoint"), F.count(F.lit(1)).alias("kept"))
        kept = one if kept is None else kept.unionByName(one)
    return ran.join(kept, "endpoint", "left")


# A correction of the fact: the first month goes, a branch's second month moves on to the fourth, another branch's third is edited.
CHANGED_SQL = """m AS (SELECT min(year_month) AS m FROM fact),
changed AS (SELECT * REPLACE (CASE WHEN branch_id = 3 AND year_month = m + INTERVAL 1 MONTH THEN CAST(m + INTERVAL 3 MONTH AS DATE) ELSE year_month END AS year_month,
    CASE WHEN branch_id = 5 AND year_month = m + INTERVAL 2 MONTH THEN 2 * transaction_amount ELSE transaction_amount END AS transaction_amount)
  FROM fact, m WHERE year_month > m)"""


@query("mart_refresh", S.with_fact(CHANGED_SQL, S.revenue_accrual_sql("changed")) + """
SELECT year_month, branch_id, CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(refunds AS DOUBLE) AS refunds,
       CAST(net_revenue AS DOUBLE) AS net_revenue, unique_patients, payment_count, primary_visits, avg_ticket
FROM revenue_accrual""")
def mart_refresh(spark, sf_dir):
    """The accrual mart after a correction that empties, moves and edits months, refreshed in the touched months alone."""
    from ..operators.marts import revenue_accrual
    fact, month = Warehouse.of(spark, sf_dir).fact, F.col("year_month")
    first = fact.agg(F.min("year_month").alias("m")).first()["m"]
    at = lambda n: F.add_months(F.lit(first).cast("date"), n)
    moved = (F.col("branch_id") == 3) & (month == at(1))
    edited = (F.col("branch_id") == 5) & (month == at(2))
    amount = F.when(edited, 2 * F.col("transaction_amount")).otherwise(F.col("transaction_amount")).cast("decimal(15,2)")
    after = fact.where(month > at(0)).withColumn("transaction_amount", amount).withColumn("year_month", F.when(moved, at(3)).otherwise(month))
    touched = fact.where((month == at(0)) | moved | edited).select("year_month").unionByName(fact.where(moved).select(at(3).alias("year_month"))).distinct()

    table = Snapshot.by_column(spark, I.scratch_dirs(spark, "mart")[0], "year_month")
    table.replace(revenue_accrual(fact))
    refresh_parts(table, lambda: revenue_accrual(after.join(touched, "year_month", "left_semi")), touched)
    return finish(table.read())
