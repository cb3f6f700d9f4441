"""Joins whose left side has keys with very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are treated as hot.
HOT_KEYS = 2000
#: A key with fewer rows is never hot.
LEAST_HOT = 10_000


def skewed_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Inner join on ``key`` with a right side that is unique per key.

    ``rows`` is a right-hand column with the number of left rows of the key, and
    ``total`` their sum. Keys with more than ``total`` / ``HOT_KEYS`` rows join by
    broadcast, so at most ``HOT_KEYS`` rows are sent; the others join by shuffle.
    Null keys match nothing.
    """
    limit = max(LEAST_HOT, total // HOT_KEYS)
    if total <= LEAST_HOT:
        return left.join(right, key)
    hot = F.broadcast(right.where(F.col(rows) > limit))
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(rows) <= limit), key)
    return left.join(hot, key).unionByName(cold)
