"""Job composition (SNK-5, INC-4, INC-5).

Each step is an independent Spark job (a callable returning a row count); a
failing step is recorded and the others still run. The result summary is a
small DataFrame ``(step, rows, error, seconds)``.
"""

from __future__ import annotations

import datetime as _dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def default_period(as_of: _dt.date, days: int = 30) -> tuple[_dt.date, _dt.date]:
    """INC-4: the default request window ``[as_of - days, as_of]`` (explicit
    ``as_of`` instead of the wall clock, so reruns are deterministic)."""
    return as_of - _dt.timedelta(days=days), as_of


def daily_window(as_of: _dt.date) -> tuple[_dt.date, _dt.date]:
    """INC-4: yesterday .. today."""
    return as_of - _dt.timedelta(days=1), as_of


def run_steps(spark: SparkSession, steps: dict[str, Callable[[], int]], skip_missing: bool = True) -> DataFrame:
    """SNK-5 / INC-5: run every step, isolating failures; a step whose input
    is absent (FileNotFoundError / path-not-found) is skipped with a note."""
    out = []
    for name, fn in steps.items():
        t = time.perf_counter()
        try:
            rows, err = int(fn()), None
        except Exception as e:  # isolate: record and continue
            msg = str(e).splitlines()[0][:300]
            if skip_missing and ("PATH_NOT_FOUND" in msg or isinstance(e, FileNotFoundError)):
                msg = "skipped: input missing"
            rows, err = None, msg
        out.append((name, rows, err, round(time.perf_counter() - t, 3)))
    return spark.createDataFrame(out, "step string, rows long, error string, seconds double")
