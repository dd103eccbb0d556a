"""FIL-9: branch scope inside the catalog, so that SQL users are bound by it.

The scope is a session variable, as a database would hold a setting of the
connection: a view over a mart shows the rows of the branch it names, and none
while it is unset. A table function gives any one branch. Both are resolved by
the analyzer, so the branch reaches the mart's scan as a filter.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

VARIABLE = "app_branch_id"


def _name(x: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", x):
        raise ValueError(f"not a name: {x}")
    return x


def register_scope(spark: SparkSession, mart_view: str, scoped_view: str, function: str | None = None, column: str = "branch_id") -> None:
    """``scoped_view`` over the view or table ``mart_view``, limited to the session's branch; ``function(branch)`` if named."""
    mart, view, column = _name(mart_view), _name(scoped_view), _name(column)
    spark.sql(f"DECLARE OR REPLACE VARIABLE {VARIABLE} INT DEFAULT NULL")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {view} AS SELECT * FROM {mart} WHERE {column} = session.{VARIABLE}")
    if function:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_name(function)}(branch INT) RETURNS TABLE RETURN SELECT * FROM {mart} WHERE {mart}.{column} = {_name(function)}.branch")


def set_scope(spark: SparkSession, branch_id: int | None) -> None:
    spark.sql(f"SET VAR {VARIABLE} = {'NULL' if branch_id is None else int(branch_id)}")
