"""Join helpers and the broadcast policy.

A broadcast hint is placed only behind a size check: ``bounded_broadcast``
asks the optimizer for the input's size estimate (file sizes after column
pruning and filters) and hints only when it is under ``max_bytes``. Beyond
that, no hint: the join stays a sort-merge join unless adaptive execution
measures the real shuffle output under
``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The estimate comes from (compressed) file sizes, so the in-memory size can be
# several times larger; the cap is kept well below executor memory.
DEFAULT_MAX_BYTES = 16 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer size estimate of a plan (no job is run); None if unknown."""
    try:
        v = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(v) if isinstance(v, int) else int(v.toString())
    except Exception:
        return None


def bounded_broadcast(df: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its estimated size is known and <= max_bytes."""
    size = estimated_bytes(df)
    return F.broadcast(df) if size is not None and size <= max_bytes else df


def lookup_join(df: DataFrame, dim: DataFrame, on, how: str = "left",
                bounded: bool = False) -> DataFrame:
    """Left lookup of ``dim`` columns by key; ``bounded=True`` marks a dimension
    expected to be small and broadcasts it after the size check."""
    right = bounded_broadcast(dim) if bounded else dim
    return df.join(right, on, how)
