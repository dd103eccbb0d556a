"""Named queries over a driver directory, each paired with its DuckDB oracle."""

from .registry import queries, oracle_sql  # noqa: F401
