"""Seed dimensions from the vocabularies (SRC-19).

Seeds are built as SQL ``VALUES`` relations: unlike a DataFrame made from a
Python list, such a local relation carries an exact size estimate, so the
broadcast size check (``operators._joins.bounded_broadcast``) can prove it small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .. import vocab


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def local_table(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """A small literal table with an exact size estimate."""
    schema = StructType.fromDDL(ddl)
    names = [f.name for f in schema.fields]
    values = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f"CAST(c{i} AS {f.dataType.simpleString()}) AS `{f.name}`" for i, f in enumerate(schema.fields))
    alias = ", ".join(f"c{i}" for i in range(len(names)))
    return spark.sql(f"SELECT {cols} FROM VALUES {values} AS t({alias})")


def payment_types(spark: SparkSession, items=vocab.PAYMENT_TYPES) -> DataFrame:
    rows = [(i + 1, n, c) for i, (n, c) in enumerate(items)]
    return local_table(spark, rows, "payment_type_id int, name string, is_cash boolean")


def expense_types(spark: SparkSession, items=vocab.EXPENSE_TYPES) -> DataFrame:
    rows = [(i + 1, n, c, p, s) for i, (n, c, p, s) in enumerate(items)]
    return local_table(spark, rows, "expense_type_id int, name string, category string, "
                                    "parent_category string, sort_order int")


def branches(spark: SparkSession, rows) -> DataFrame:
    """rows: (branch_id, name, code, display_name, legal_entity_id, mis_name, cf_name)."""
    return local_table(spark, rows, "branch_id int, name string, code string, display_name string, "
                                    "legal_entity_id int, mis_name string, cf_name string")


def aliases(spark: SparkSession, mapping: dict) -> DataFrame:
    """Alias -> canonical code table for branch resolution."""
    return local_table(spark, sorted(mapping.items()), "alias string, code string")
