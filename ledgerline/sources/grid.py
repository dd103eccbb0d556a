"""Spreadsheet grids as a long cell table (SRC-3, SRC-4; FIL-11).

A grid arrives as cells ``(source_file, sheet, row_idx, col_idx, value)``.
Header cells are joined to data cells on (file, sheet, column) and line-item
cells on (file, sheet, row) — set-based, so many files and sheets are handled
in one job; the header frames are as small as the sheet is wide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SHEET = ["source_file", "sheet"]


def _numeric_nonzero(v):
    """Money of a cell, exact, and whether the cell is a number that isn't zero."""
    x = F.trim(v).try_cast("decimal(15,2)")
    return x, x.isNotNull() & (x != F.lit(0))


def grid_unpivot_svod(cells: DataFrame, label: str = "Статья", ym_row: int = 0, entity_row: int = 1,
                      header_row: int = 5, data_from: int = 6) -> DataFrame:
    """Consolidated monthly grid: row ``ym_row`` holds the year-month, row
    ``entity_row`` the legal entity, the column whose ``header_row`` cell is
    ``label`` holds line items; a data column needs *both* headers."""
    stat = (cells.where((F.col("row_idx") == header_row) & (F.trim("value") == F.lit(label)))
            .groupBy(*SHEET).agg(F.min("col_idx").alias("stat_col")))
    ym = cells.where(F.col("row_idx") == ym_row).select(*SHEET, "col_idx", F.col("value").alias("year_month_str"))
    le = cells.where(F.col("row_idx") == entity_row).select(*SHEET, "col_idx", F.col("value").alias("legal_entity"))
    hdr = (ym.join(le, SHEET + ["col_idx"], "inner")
           .where(F.col("year_month_str").isNotNull() & F.col("legal_entity").isNotNull())
           .join(stat, SHEET, "inner").where(F.col("col_idx") > F.col("stat_col")).drop("stat_col"))
    body = cells.where(F.col("row_idx") >= data_from)
    labels = (body.join(stat, SHEET, "inner").where(F.col("col_idx") == F.col("stat_col"))
              .select(*SHEET, "row_idx", F.trim("value").alias("line_item"))
              .where(F.col("line_item").isNotNull() & (F.length("line_item") > 0)))
    amount, keep = _numeric_nonzero(F.col("value"))
    data = body.withColumn("amount", amount).where(keep)
    out = data.join(hdr, SHEET + ["col_idx"], "inner").join(labels, SHEET + ["row_idx"], "inner")
    return out.select(F.trim("year_month_str").alias("year_month_str"), F.trim("legal_entity").alias("legal_entity"),
                      "line_item", "amount", "source_file")


def grid_unpivot_clinics(cells: DataFrame, allowed, name_row: int = 1, label_col: int = 1,
                         data_from: int = 3) -> DataFrame:
    """Per-branch grid: branch names in ``name_row`` (kept only if allowed),
    line item in column ``label_col``, data from ``data_from``. ``allowed`` is
    a list of names or a one-column DataFrame (semi-join)."""
    names = (cells.where(F.col("row_idx") == name_row)
             .select(*SHEET, "col_idx", F.trim("value").alias("branch")).where(F.length("branch") > 0))
    if isinstance(allowed, DataFrame):
        names = names.join(allowed.select(F.col(allowed.columns[0]).alias("branch")), "branch", "left_semi")
    else:
        names = names.where(F.col("branch").isin(list(allowed)))
    body = cells.where(F.col("row_idx") >= data_from)
    labels = (body.where(F.col("col_idx") == label_col)
              .select(*SHEET, "row_idx", F.trim("value").alias("line_item"))
              .where(F.col("line_item").isNotNull() & (F.length("line_item") > 0)))
    amount, keep = _numeric_nonzero(F.col("value"))
    data = body.withColumn("amount", amount).where(keep)
    out = data.join(names, SHEET + ["col_idx"], "inner").join(labels, SHEET + ["row_idx"], "inner")
    return out.select("branch", "line_item", "amount", "source_file")
