"""Streaming: one vs several micro-batches give the same table; a replay of
the same input through the same checkpoint changes nothing."""

import os
import tempfile

from pyspark.sql import functions as F

from ledgerline.streaming import incremental as I


SCHEMA = "k int, updated_at timestamp, id int, v string"


def _land(rows, directory, name):
    """Drop one Parquet file into a landing directory (what an uploader does)."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    os.makedirs(directory, exist_ok=True)
    t = pa.table({"k": pa.array([r[0] for r in rows], pa.int32()),
                  "updated_at": pa.array([r[1] for r in rows], pa.timestamp("us", tz="UTC")),
                  "id": pa.array([r[2] for r in rows], pa.int32()),
                  "v": pa.array([r[3] for r in rows], pa.string())})
    pq.write_table(t, os.path.join(directory, name))


def test_one_vs_many_batches_and_replay(spark):
    import datetime as dt
    from pyspark.sql.types import StructType
    utc = dt.timezone.utc
    t = [dt.datetime(2025, 1, d, tzinfo=utc) for d in (1, 2, 3)]
    rows = [(1, t[0], 1, "a"), (1, t[2], 2, "c"), (2, t[1], 3, "x"), (1, t[1], 4, "b")]
    root = tempfile.mkdtemp(prefix="ll-stream-")
    st = StructType.fromDDL(SCHEMA)

    # all rows in one landed file -> one micro-batch
    one, out1, ck1 = (os.path.join(root, x) for x in ("one", "out1", "ck1"))
    _land(rows, one, "f0.parquet")
    I.run_to_end(I.stream_changes(spark, one, st, out1, ck1))
    # one file per row, each run picking up the new file -> four micro-batches
    many, out2, ck2 = (os.path.join(root, x) for x in ("many", "out2", "ck2"))
    for i, r in enumerate(rows):
        _land([r], many, f"f{i}.parquet")
        I.run_to_end(I.stream_changes(spark, many, st, out2, ck2))
    assert spark.read.parquet(out2).select("batch_id").distinct().count() == 4
    a = {r.k: r.v for r in I.read_latest(spark, out1, "k", "updated_at", "id").collect()}
    b = {r.k: r.v for r in I.read_latest(spark, out2, "k", "updated_at", "id").collect()}
    assert a == b == {1: "c", 2: "x"}
    # replay through the same checkpoint: nothing new, no duplicate rows
    before = spark.read.parquet(out1).count()
    I.run_to_end(I.stream_changes(spark, one, st, out1, ck1))
    assert spark.read.parquet(out1).count() == before == len(rows)


def test_events_daily_stream_matches_batch_for_closed_days(spark, sf_dir):
    from ledgerline.sources.driver import read
    ev = read(spark, sf_dir, "events")
    out, ck = I.scratch_dirs(spark, "t-daily")
    I.run_to_end(I.stream_events_daily(spark, sf_dir, ev.schema, out, ck, glob="events.parquet"))
    s = spark.read.parquet(out)
    wm = ev.agg(F.max("ts")).collect()[0][0] - __import__("datetime").timedelta(days=1)
    b = I.events_daily(ev).where(F.col("window_end") <= F.lit(wm))
    key = ["window_start", "event_type", "events", "value_sum"]
    assert sorted(map(tuple, s.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))


def test_change_events_dedup_and_late_data(spark):
    """Replayed events are counted once; an event older than the watermark
    when it arrives is not counted."""
    import json
    root = tempfile.mkdtemp(prefix="ll-events-")
    src, out, ck = (os.path.join(root, x) for x in ("in", "out", "ck"))
    os.makedirs(src)

    def ev(kind, ts, tid, branch, amount):
        return json.dumps({"event": kind, "timestamp": ts, "signature": "x",
                           "data": {"transaction_id": tid, "branch_id": branch, "amount": amount}})

    def land(name, lines):
        with open(os.path.join(src, name), "w") as f:
            f.write("\n".join(lines) + "\n")

    land("b0.json", [ev("paid", "2025-01-01T10:00:00Z", 1, 1, 100.0),
                     ev("paid", "2025-01-01T10:00:00Z", 1, 1, 100.0),      # exact replay
                     ev("created", "2025-01-01T09:00:00Z", 2, 1, 50.0),    # other event type
                     ev("paid", "2025-01-01T12:00:00Z", 3, 2, 30.0)])
    I.run_to_end(I.stream_change_events(spark, src, out, ck))
    land("b1.json", [ev("paid", "2025-01-03T08:00:00Z", 4, 1, 10.0)])     # moves the watermark past Jan 1-2
    I.run_to_end(I.stream_change_events(spark, src, out, ck))
    # the watermark advances between micro-batches: this event arrives after it passed Jan 1
    land("b2.json", [ev("paid", "2025-01-01T23:00:00Z", 5, 1, 999.0)])
    I.run_to_end(I.stream_change_events(spark, src, out, ck))
    land("b3.json", [ev("paid", "2025-01-05T08:00:00Z", 6, 1, 1.0)])      # closes Jan 3
    I.run_to_end(I.stream_change_events(spark, src, out, ck))
    got = sorted((str(r.day)[:10], r.branch_id, r.events, float(r.amount)) for r in spark.read.parquet(out).collect())
    assert got == [("2025-01-01", 1, 1, 100.0), ("2025-01-01", 2, 1, 30.0), ("2025-01-03", 1, 1, 10.0)]
