"""Similarity and divergence of arrays as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def to_distribution(v: Column) -> Column:
    """The vector divided by its sum; a vector that sums to 0 stays as it is.

    The sum is bound to a variable, so that it isn't computed again for every element.
    """
    bound = F.array(F.struct(v.alias("v"), total(v).alias("s")))
    return F.element_at(F.transform(bound, lambda t: F.when(t["s"] == 0, t["v"]).otherwise(F.transform(t["v"], lambda x: x / t["s"]))), 1)


def _sum2(a: Column, b: Column, f) -> Column:
    return total(F.zip_with(a, b, f))


def l1(a: Column, b: Column) -> Column:
    return _sum2(a, b, lambda x, y: F.abs(x - y))


def l2(a: Column, b: Column) -> Column:
    """Sum of squared differences of the square roots."""
    return _sum2(a, b, lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y)))


def _xlog(x: Column, y: Column) -> Column:
    """x ln(x / y) with 0 ln 0 = 0 and x ln(x / 0) = infinity."""
    return F.when(x == 0, F.lit(0.0)).when(y == 0, F.lit(math.inf)).otherwise(x * F.log(x / y))


def kl(a: Column, b: Column) -> Column:
    return _sum2(a, b, _xlog)


def lk(a: Column, b: Column) -> Column:
    return kl(b, a)


def irad(a: Column, b: Column) -> Column:
    """Information radius: sum of b ln(b/(a+b)) + a ln(a/(a+b))."""
    return _sum2(a, b, lambda x, y: _xlog(x, x + y) + _xlog(y, x + y))


DIVERGENCES = {"l1": l1, "l2": l2, "kl": kl, "lk": lk, "irad": irad}


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements; 0 for two empty sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def relatedness(size_a: Column, size_b: Column, overlap: Column, articles: float, smoothing: float = 0.0) -> Column:
    """exp(-(ln max - ln overlap) / (ln articles - ln min)) of two in-link sets; 0 without overlap."""
    a, b, o = size_a + smoothing, size_b + smoothing, overlap + smoothing
    near = F.exp(-(F.log(F.greatest(a, b)) - F.log(o)) / (F.lit(math.log(articles)) - F.log(F.least(a, b))))
    return F.when(o <= 0, F.lit(0.0)).otherwise(near)


#: So many numbers of points are sent to the rows in one go.
MOST_NUMBERS = 4_000_000


def nearest(rows: DataFrame, id: str, vector: str, points: DataFrame, name: str, point: str) -> DataFrame:
    """``id``, ``name``, ``div``: the point with the least KL divergence of each row, rounded to 9 digits, on a tie
    the first by name; rows without a vector or points don't come out.

    All points are one array that each row scans, so rows are neither multiplied nor shuffled. The points
    are broadcast in blocks of ``MOST_NUMBERS`` numbers; rows keep the best of the blocks.
    """
    p = points.where(F.col(point).isNotNull() & F.col(name).isNotNull())
    width = p.agg(F.max(F.size(point))).first()[0] or 1
    blocks = -(-p.count() * width // MOST_NUMBERS) or 1
    packed = p.groupBy(F.pmod(F.xxhash64(name), F.lit(blocks)).alias("_k")).agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col(point).alias("point"))).alias("_all"))
    best = rows.select(id, vector, F.lit(None).cast(f"struct<div: double, name: {p.schema[name].dataType.simpleString()}>").alias("_best"))
    for k in range(blocks):
        block = packed.where(F.col("_k") == k).select("_all").scalar()
        found = F.array_min(F.transform("_all", lambda x: F.struct(F.round(kl(F.col(vector), x["point"]), 9).alias("div"), x["name"].alias("name"))))
        best = best.withColumn("_all", block).select(id, vector, F.least("_best", found).alias("_best"))
    return best.where(F.col("_best.div").isNotNull()).select(id, F.col("_best.name").alias(name), F.col("_best.div").alias("div"))
