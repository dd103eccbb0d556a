"""Sinks (SNK-1..5).

Writes are whole-partition overwrites (dynamic partition overwrite), so a
retried task or a re-run job replaces its own output instead of duplicating
it. Row counts come from ``observe`` during the write — no second scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def write_table(df: DataFrame, target: str, mode: str = "overwrite", partition_by=None,
                fmt: str = "parquet", columns=None, overwrite: str = "static") -> int:
    """SNK-1/4: project to ``columns`` (if given), write, return the row count.

    ``overwrite`` says what an overwrite of a partitioned target replaces, whatever
    the session's setting: ``static`` the whole table, ``dynamic`` only the
    partitions that ``df`` has.
    """
    if columns:
        df = df.select(*columns)
    obs = Observation("write")
    df = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = df.write.mode(mode).format(fmt).option("partitionOverwriteMode", overwrite)
    if fmt == "parquet":
        w = w.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if "/" in target:
        w.save(target)
    else:
        w.saveAsTable(target)
    return int(obs.get.get("rows", 0))


def write_mart(df: DataFrame, target: str, partition_by: str = "year_month") -> int:
    """SNK-2: materialise a mart partitioned by month; with dynamic partition
    overwrite only the months present in ``df`` are replaced (incremental
    refresh of touched months)."""
    # REBALANCE keeps files per month few, and AQE splits a hot month's rows
    # over several tasks instead of one.
    return write_table(df.hint("rebalance", partition_by), target, "overwrite", partition_by, overwrite="dynamic")


def append_new(new: DataFrame, existing: DataFrame, key, target: str) -> int:
    """SNK-3: insert-if-absent — anti-join on the natural key, then append one row per new key."""
    keys = [key] if isinstance(key, str) else list(key)
    fresh = new.join(existing.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return write_table(fresh, target, "append")


def append_frames(*frames: DataFrame) -> DataFrame:
    """SET-1: UNION ALL by column name; columns missing on one side are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
