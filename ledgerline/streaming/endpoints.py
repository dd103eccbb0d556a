"""Streams of several endpoints into their silver tables (INC-2, INC-5) and daily totals (INC-6).

Each endpoint is a stream of landed files with its own checkpoint and a bound
on what one micro-batch takes. A batch is merged, appended or put in place of
the endpoint's table, by a commit that knows the batch: one that is delivered
again after a lost driver changes nothing. Rows are counted by ``observe`` in
the same scan and gathered by a listener. An endpoint that fails is reported,
and the others run to their end.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from ..snapshots import Snapshot

MERGE, APPEND, REPLACE = "merge", "append", "replace"


@dataclass
class Endpoint:
    """Where records land and how they change the table: ``merge`` (newest of a key), ``append`` or ``replace`` (every batch is whole)."""
    name: str
    source: str
    schema: StructType
    table: Snapshot
    mode: str = MERGE
    key: object = None
    version: str | None = None
    tiebreak: str | None = None
    fmt: str = "parquet"
    glob: str | None = None

    def __post_init__(self):
        if self.mode not in (MERGE, APPEND, REPLACE):
            raise ValueError(f"unknown mode {self.mode}")

    def writer(self, checkpoint: str):
        """What a stream does with its batches; they are numbered by checkpoint, so the ledger knows them by it."""
        def apply(batch: DataFrame, batch_id: int) -> None:
            if self.mode == MERGE:
                self.table.merge(batch, self.key, self.version, self.tiebreak, writer=checkpoint, batch=batch_id)
            elif self.mode == APPEND:
                self.table.append(batch, writer=checkpoint, batch=batch_id)
            else:
                self.table.replace(batch, None, writer=checkpoint, batch=batch_id)
        return apply


class _Counts(StreamingQueryListener):
    """Observed rows of each stream by its name, and an event that tells its end."""

    def __init__(self, names):
        self.rows, self.ended = {n: 0 for n in names}, {}
        self.of = {}

    def onQueryStarted(self, event):
        self.of[str(event.runId)] = event.name
        self.ended.setdefault(event.name, threading.Event())

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics.get("taken")
        if seen is not None and event.progress.name in self.rows:
            self.rows[event.progress.name] += seen["rows"]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if (name := self.of.get(str(event.runId))) in self.ended:
            self.ended[name].set()


def _error(e: BaseException) -> str:
    """The error class where there is one, else the first line."""
    kind = getattr(e, "getCondition", lambda: None)() or getattr(e, "getErrorClass", lambda: None)()
    return kind or (str(e).splitlines() or [type(e).__name__])[0][:300]


def run_endpoints(spark: SparkSession, endpoints: list[Endpoint], checkpoints: str, max_files: int = 100, max_bytes: str | None = None) -> DataFrame:
    """Bring every endpoint up to date: (endpoint, rows, error), one row each.

    ``max_files`` (or ``max_bytes``, not both) bounds a micro-batch, whatever has
    piled up. Streams run at the same time; ``rows`` counts what this run took.
    """
    counts, running, errors = _Counts([e.name for e in endpoints]), {}, {}
    spark.streams.addListener(counts)
    try:
        for e in endpoints:
            try:
                reader = spark.readStream.schema(e.schema).format(e.fmt)
                reader = reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader.option("maxFilesPerTrigger", max_files)
                if e.glob:
                    reader = reader.option("pathGlobFilter", e.glob)
                taken = reader.load(e.source).observe("taken", F.count(F.lit(1)).alias("rows"))
                running[e.name] = (taken.writeStream.queryName(e.name).foreachBatch(e.writer(f"{checkpoints}/{e.name}")).trigger(availableNow=True)
                                   .option("checkpointLocation", f"{checkpoints}/{e.name}").start())
            except Exception as x:   # a stream that can't start is its endpoint's failure alone
                errors[e.name] = _error(x)
        for name, query in running.items():
            try:
                query.awaitTermination()
            except Exception as x:
                errors[name] = _error(x)
            if name in counts.ended:
                counts.ended[name].wait(30)   # the listener hears of the end a little later
    finally:
        spark.streams.removeListener(counts)
    rows = [(e.name, None if e.name in errors else counts.rows[e.name], errors.get(e.name)) for e in endpoints]
    return spark.createDataFrame(rows, "endpoint string, rows long, error string")


def stream_daily_totals(spark: SparkSession, source: str, schema: StructType, table: Snapshot, checkpoint: str, watermark: str = "1 day",
                        ts: str = "ts", key: str = "event_type", dedup_key: str = "event_id", value: str = "value", glob: str | None = None,
                        max_files: int = 100) -> None:
    """INC-6: totals per day and kind, open days included, brought up to date by each micro-batch.

    The aggregation runs in update mode: a batch emits the new totals of the days
    it touched, and they take the place of the old ones in ``table`` (keyed by
    window_start and ``key``). Days stay open until the watermark has passed
    them; events later than that are not counted. A batch that is delivered
    again is found in the table's ledger.
    """
    reader = spark.readStream.schema(schema).format("parquet").option("maxFilesPerTrigger", max_files)
    events = (reader.option("pathGlobFilter", glob) if glob else reader).load(source)
    events = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([dedup_key])
    totals = events.groupBy(F.window(ts, "1 day").alias("w"), key).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col(value).cast("decimal(18,2)")).alias("value_sum"))
    totals = totals.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "events", "value_sum")

    def put(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch.withColumn("batch", F.lit(batch_id).cast("long")), ["window_start", key], "batch", writer=checkpoint, batch=batch_id)

    query = totals.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
