"""Places in a total order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: its place, from 1, in the order of the columns ``order``.

    Rows are range partitioned and sorted in their partitions, and that is
    checkpointed, so the places hold when an executor is lost; a place is the
    rows of all partitions before plus the place in the own one. What is
    gathered and broadcast has one row a partition. The order should be total,
    or places among equal rows are any.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes, before, rows = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect(), 0, []
    for part_id, n in sorted(map(tuple, sizes)):
        rows.append((part_id, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(rows, "_part long, _before long"))
    placed = placed.withColumn("_part", part).withColumn("_within", within).join(starts, "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_within") + 1).drop("_at", "_part", "_within", "_before")
