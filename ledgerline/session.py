"""SparkSession construction and cluster-wide settings.

On a cluster the session comes from the platform; ``configure`` only fills in
settings that are still unset, so a cluster's own choices always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC instants, ANSI errors, adaptive execution
# (runtime partition coalescing, skew-join splitting, broadcast conversion
# from measured shuffle sizes).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A task writes its months side by side instead of sorting all its rows by
    # month first, which spills; beyond so many months it sorts as before.
    "spark.sql.maxConcurrentOutputFileWriters": "128",
    # Streaming state (dedup ids within the watermark, open windows) can be
    # large at volume: keep it in RocksDB (off-heap, spills to local disk,
    # checkpointed to the shared folder) instead of the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "ledgerline",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults above.

    ``master`` is only for local runs and tests; on a cluster leave it None.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        b = b.config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEM", "16g"))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULTS to an existing session where the key is unset."""
    for k, v in DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (distributed file system) folder there. Only when
    the setting is absent — local runs and tests — do we create our own.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Connect session: only the session setting is visible
        sc = None
    if sc is None:
        d = spark.conf.get("spark.checkpoint.dir", None)
        return d or tempfile.mkdtemp(prefix="ledgerline-ckpt-")
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # not readable as a session setting
            d = None
    if not d:
        if not sc.master.startswith("local"):  # executors can't see a folder of the driver's machine
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="ledgerline-ckpt-")  # local runs and tests only
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.replace("file:", "", 1) if d.startswith("file:") else d
