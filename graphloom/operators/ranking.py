"""Ranks and running aggregates within groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import cut

#: A group of more rows is split by its order.
HOT_ROWS = 500_000
#: So many parts of split groups there are at most, about; groups that this bound leaves whole
#: have at most a ``PIECES``th of all rows.
PIECES = 20_000
#: Rows looked at for each part, to choose where parts begin.
PER_PIECE = 20

_COMBINE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b)}
_OF = {"sum": F.sum, "max": F.max}
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def running_within(df: DataFrame, group: list[str], order: list[str], **running: tuple[str, Column]) -> DataFrame:
    """Adds a column per keyword: the running 'sum' or 'max' of an expression within each group by ``order``.

    Groups are spread by hash and scanned in order, with one shuffle. A group of more than
    ``HOT_ROWS`` rows is split into ranges of its order, which are parts of their own in
    the same shuffle; what a group has in earlier parts is put before a part, from a table of at
    most about ``PIECES`` rows that is broadcast. Without ``group`` the whole table is
    sorted by range. Where ranges begin comes from a sample; results don't depend on it.
    Nulls come first in the order and are left out of sums and maxima; a sum of nothing is 0. ``order`` must
    tell the rows of a group apart for the results to be defined.
    """
    if not group:
        return _running_over_all(df, order, running)
    d = cut(df)
    aggs = {n: _OF[kind](e) for n, (kind, e) in running.items()}
    sizes = d.groupBy(*group).agg(F.count("*").alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(HOT_ROWS, (total or 0) // PIECES)
    if (most or 0) <= limit:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(*_SO_FAR)
        return d.select("*", *[_COMBINE[running[n][0]](a.over(w), F.lit(None)).alias(n) for n, a in aggs.items()])
    names = [f"_g{i}" for i in range(len(group))]
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names)])
    hot = F.broadcast(sizes.where(F.col("_n") > limit).select(*[F.col(g).alias(n) for g, n in zip(group, names)]))  # at most PIECES
    at = F.struct(*order)
    seen = d.join(hot, same).where(F.rand(1) < PER_PIECE / limit).groupBy(*names).agg(F.sort_array(F.collect_list(at)).alias("_all"))
    every = lambda c, n: F.filter(c, lambda x, i: i % n == 0)
    starts = cut(seen.select(*names, every(F.col("_all"), F.lit(PER_PIECE)).alias("_starts")).withColumn("_step", F.ceil(F.sqrt(F.size("_starts"))).cast("int")).withColumn("_heads", every(F.col("_starts"), F.col("_step"))))
    upto = lambda c: F.size(F.filter(c, lambda x: x <= at))
    block = upto(F.col("_heads"))
    piece = F.when(F.coalesce(block, F.lit(0)) <= 0, 0).otherwise((F.col("_block") - 1) * F.col("_step") + upto(F.slice("_starts", (F.col("_block") - 1) * F.col("_step") + 1, F.col("_step"))))
    parts = d.join(F.broadcast(starts), same, "left").withColumn("_block", block).withColumn("_piece", piece).select(*d.columns, "_piece", F.col("_step").isNotNull().alias("_hot"))
    each = parts.where("_hot").groupBy(*group, "_piece").agg(*[a.alias(f"_v{i}") for i, a in enumerate(aggs.values())])
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(*_BEFORE)
    bases = each.select(*[F.col(g).alias(n) for g, n in zip(group, names)], F.col("_piece").alias("_p"), *[_OF[kind](f"_v{i}").over(before).alias(f"_b{i}") for i, (kind, _) in enumerate(running.values())])
    w = Window.partitionBy(*group, "_piece").orderBy(*order).rowsBetween(*_SO_FAR)
    local = parts.select(*d.columns, "_piece", *[a.over(w).alias(f"_r{i}") for i, a in enumerate(aggs.values())])
    joined = local.join(F.broadcast(bases), same & (F.col("_piece") == F.col("_p")), "left")
    return joined.select(*d.columns, *[_COMBINE[running[n][0]](F.col(f"_r{i}"), F.col(f"_b{i}")).alias(n) for i, n in enumerate(running)])


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows in order, written with the number of their range, ``_part``, and their place in it from 1, ``_nth``."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    return cut(ordered.withColumn("_nth", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33) + 1))


def _running_over_all(df: DataFrame, order: list[str], running: dict[str, tuple[str, Column]]) -> DataFrame:
    ordered = _ranges(df, order)
    each = ordered.groupBy("_part").agg(*[_OF[kind](e).alias(f"_v{i}") for i, (kind, e) in enumerate(running.values())])
    before = Window.orderBy("_part").rowsBetween(*_BEFORE)  # one row per range
    bases = F.broadcast(each.select(F.col("_part").alias("_p"), *[_OF[kind](f"_v{i}").over(before).alias(f"_b{i}") for i, (kind, _) in enumerate(running.values())]))
    w = Window.partitionBy("_part").orderBy("_nth").rowsBetween(*_SO_FAR)
    local = ordered.select("*", *[_OF[kind](e).over(w).alias(f"_r{i}") for i, (kind, e) in enumerate(running.values())])
    joined = local.join(bases, F.col("_part") == F.col("_p"))
    return joined.select(*df.columns, *[_COMBINE[running[n][0]](F.col(f"_r{i}"), F.col(f"_b{i}")).alias(n) for i, n in enumerate(running)])


def rank_within(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds ``name``, the row number from 1 within each group by ``order`` (see ``running_within``).

    Without ``group`` a row's number is its place in its sorted range and the rows of
    the ranges before, so the rows are shuffled once and never scanned by a window.
    """
    if group:
        return running_within(df, group, order, **{name: ("sum", F.lit(1).cast("bigint"))})
    ordered = _ranges(df, order)
    before = Window.orderBy("_part").rowsBetween(*_BEFORE)  # one row per range
    bases = ordered.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    joined = ordered.join(F.broadcast(bases), F.col("_part") == F.col("_p"))
    return joined.select(*df.columns, (F.col("_b") + F.col("_nth")).alias(name))
