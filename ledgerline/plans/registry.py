"""Query registry: ``name -> (spark, sf_dir) -> DataFrame`` plus oracle SQL.

Each plan module registers its queries with ``@query(name, sql)``; ``sql`` is
the same computation written for DuckDB over the raw driver tables (``None``
for operators that are not SQL-expressible, which get a rows-only check).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DecimalType

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

_MODULES = ["marts", "reports", "planning", "quality", "ingest", "statements", "incremental"]


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _load():
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def _configured(fn):
    def run(spark, sf_dir):
        from ..session import configure
        configure(spark)  # UTC session time zone, AQE defaults (only where unset)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable]:
    _load()
    return {k: _configured(v) for k, v in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def finish(df: DataFrame) -> DataFrame:
    """Edge rendering: exact DECIMAL money becomes double only here."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])
