from pyspark.sql import Column, functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
