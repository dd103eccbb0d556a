"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HEAVY_KEYS = 10_000   # at most so many keys are broadcast


def by_weight(big: DataFrame, small: DataFrame, on: str, weight: str) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row a key), whose ``weight`` tells how many rows of ``big`` have the key.

    Keys with more than 1 / HEAVY_KEYS of all that weight are HEAVY_KEYS at
    most, whatever the size of the data: they are broadcast, and rows of hot
    keys stay where they are. All other keys meet in a shuffle, in which no key
    has more than that share. ``weight`` isn't returned; ``small`` is read
    three times, so it should be a checkpoint.
    """
    total = small.agg(F.sum(weight).alias("n")).first()["n"] or 0
    hot = F.col(weight) > total // HEAVY_KEYS
    heavy = F.broadcast(small.filter(hot).drop(weight))
    rest = big.join(F.broadcast(small.filter(hot).select(on)), on, "left_anti").join(small.filter(~hot).drop(weight), on)
    return big.join(heavy, on).unionByName(rest)
