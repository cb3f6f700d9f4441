"""Results per key when a few keys hold most of the rows.

``key_ranks`` finds the values at given ranks of every key exactly. Hot keys are
never gathered: each round counts a histogram per key (counts merge before the
shuffle), keeps for every wanted rank the bucket that holds it, and splits that
bucket again. ``heavy_keys`` finds all keys above a share of the rows by the same
selection over the order of key hashes.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.operators.ranking import rank_within
from graphloom.session import cut, discard

#: At most so many buckets under refinement at a time; they are what is broadcast.
MAX_CELLS = 100_000
#: Groups of up to so many rows are finished by sorting them within one task.
SMALL = 10_000


def order_code(c: Column, kind: T.DataType) -> Column:
    """A bigint that sorts like ``c``: integers, dates, timestamps and floating numbers."""
    if isinstance(kind, T.IntegralType):
        return c.cast("bigint")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone()))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    raise TypeError(f"no order code for {kind.simpleString()}")


def from_code(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegralType):
        return c.cast(kind)
    if isinstance(kind, T.TimestampNTZType):
        return F.to_utc_timestamp(F.timestamp_micros(c), F.current_timezone()).cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(c)
    return F.date_from_unix_date(c.cast("int"))


def key_ranks(df: DataFrame, keys: list[str], code: str, ranks: Column, buckets: int = 256, small: int = SMALL, least: Column | None = None) -> DataFrame:
    """Columns ``keys``, ``n``, ``rank``, ``code``: the value of each wanted rank of each key.

    ``code`` is a bigint column whose largest and smallest value per key lie less
    than 2**63 apart. ``ranks`` is an expression over ``n``, the key's rows with a
    value, giving an array of ranks from 1; ranks above ``n`` are left out and
    repeated ranks come once. Rows with a null ``code`` are ignored; keys may be
    null and null keys form one key. An empty input gives an empty result.

    With ``least``, an expression over ``n``, only values with at least so many rows are
    wanted: ranks in a bucket with fewer rows are given up, and others are followed
    until their bucket holds one value.

    Groups of at most ``small`` rows are sorted within one task. Hot groups, those with more
    than ``MAX_CELLS`` / ranks per group of all rows as well, are refined by histograms; their
    buckets, of which there are at most ``MAX_CELLS``, are broadcast. Groups between
    the two, which there are in very large inputs only, are too many for that: they are ranked
    by a distributed sort (``rank_within``). No group is gathered at any size.
    """
    d = df.where(F.col(code).isNotNull()).select(*[F.col(k) for k in keys], F.col(code).alias("_code"))
    stats = cut(d.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_code").alias("_lo"), F.max("_code").alias("_hi")))
    wanted = F.array_distinct(F.filter(ranks, lambda r: (r >= 1) & (r <= F.col("n"))))
    total, most = stats.agg(F.sum("n"), F.max(F.size(wanted))).first()
    hot = max(small, -(-(total or 0) * (most or 1) // MAX_CELLS))
    renamed = lambda t, *more: t.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *more)
    on_keys = lambda a, b: _all(a[k].eqNullSafe(b[f"_k{i}"]) for i, k in enumerate(keys))

    big = stats.where((F.col("n") > hot) & (F.col("_lo") < F.col("_hi")))
    constant = stats.where((F.col("n") > hot) & (F.col("_lo") == F.col("_hi"))).select(*keys, "n", F.explode(wanted).alias("rank"), F.col("_lo").alias("code"))
    heavy = F.broadcast(renamed(stats.where(F.col("n") > hot)))
    rest = d.join(heavy, on_keys(d, heavy), "left_anti")
    parts = [constant]
    if hot > small:
        sizes = renamed(stats.where(F.col("n") <= hot), "n")
        rest = rest.join(sizes, on_keys(rest, sizes)).select(*keys, "_code", "n")
        ranked = rank_within(rest.where(F.col("n") > small), keys, ["_code"], "_rank")
        asked = renamed(stats.where((F.col("n") > small) & (F.col("n") <= hot)), F.explode(wanted).alias("rank"))
        parts.append(ranked.join(asked, on_keys(ranked, asked) & (F.col("_rank") == F.col("rank"))).select(*keys, "n", "rank", F.col("_code").alias("code")))
        rest = rest.where(F.col("n") <= small)
    light = rest.groupBy(*keys).agg(F.sort_array(F.collect_list("_code")).alias("_all"))
    light = light.withColumn("n", F.size("_all").cast("bigint")).select(*keys, "n", "_all", F.explode(wanted).alias("rank"))
    parts.append(light.select(*keys, "n", "rank", F.element_at("_all", F.col("rank").cast("int")).alias("code")))

    # The buckets to split: _left is the wanted rank within the bucket.
    # _cell numbers the buckets of a round, _id those of them that are split again.
    zero = F.lit(0).cast("bigint")
    state = big.select(*keys, zero.alias("_cell"), zero.alias("_id"), "_lo", "_hi", "n", F.explode(wanted).alias("rank")).withColumn("_left", F.col("rank"))
    numbered = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_cell")).cast("bigint")
    rows = d.withColumn("_cell", zero)
    state = cut(state)
    while not state.isEmpty():
        cells = renamed(state, F.col("_cell").alias("_c"), "_id", "_lo", "_hi").distinct()
        split = rows.join(F.broadcast(cells), on_keys(rows, cells) & (rows["_cell"] == cells["_c"])).select(*keys, "_code", (F.col("_id") * buckets + F.expr(f"(_code - _lo) div ((_hi - _lo) div {buckets} + 1)")).alias("_cell"))
        before, rows = rows, cut(split)  # rows in no bucket under refinement are gone
        discard(before)
        hist = rows.groupBy(*keys, "_cell").agg(F.count("*").alias("_rows"), F.min("_code").alias("_lo"), F.max("_code").alias("_hi")).withColumn("_parent", F.expr(f"_cell div {buckets}"))
        w = Window.partitionBy(*keys, "_parent").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("_upto", F.sum("_rows").over(w))
        s = renamed(state, F.col("_id").alias("_c"), "n", "rank", "_left")
        on = on_keys(hist, s) & (hist["_parent"] == s["_c"]) & (F.col("_left") <= F.col("_upto")) & (F.col("_left") > F.col("_upto") - F.col("_rows"))
        found = cut(hist.join(s, on).select(*keys, "_cell", "_lo", "_hi", "n", "_rows", "rank", (F.col("_left") - F.col("_upto") + F.col("_rows")).alias("_left")))
        if least is not None:
            found = found.where(F.col("_rows") >= least)
        edge = F.when(F.col("_left") == 1, F.col("_lo")).when(F.col("_left") == F.col("_rows"), F.col("_hi")).when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
        parts.append(found.withColumn("code", edge).where(F.col("code").isNotNull()).select(*keys, "n", "rank", "code"))
        found = found.where(edge.isNull())
        if least is not None:
            state = found.withColumn("_id", numbered)
            continue
        little = found.where(F.col("_rows") <= small)
        picked = little.groupBy(*keys, "_cell", "n").agg(F.collect_list(F.struct("rank", "_left")).alias("_ranks"))
        p = renamed(picked, F.col("_cell").alias("_c"), "n", "_ranks")
        cell_ids = F.broadcast(p.drop("n", "_ranks"))
        sorted_cells = rows.join(cell_ids, on_keys(rows, cell_ids) & (rows["_cell"] == cell_ids["_c"]), "left_semi").groupBy(*keys, "_cell").agg(F.sort_array(F.collect_list("_code")).alias("_all"))
        done = sorted_cells.join(p, on_keys(sorted_cells, p) & (sorted_cells["_cell"] == p["_c"])).select(*keys, "n", "_all", F.explode("_ranks").alias("_r"))
        parts.append(cut(done.select(*keys, "n", F.col("_r.rank").alias("rank"), F.element_at("_all", F.col("_r._left").cast("int")).alias("code"))))
        state = found.where(F.col("_rows") > small).withColumn("_id", numbered)
    discard(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def key_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], **how) -> DataFrame:
    """Columns ``keys``, ``n``, ``prob``, ``value``: exact quantiles per key.

    The quantile for p is the value of rank max(1, ceil(p * n)) among the key's
    non-null values; keys without such a value don't come out.
    """
    kind = df.schema[value].dataType
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p).cast("decimal(9,6)") * F.col("n"))).cast("bigint")
    coded = cut(df.select(*keys, order_code(F.col(value), kind).alias("_v")))
    found = key_ranks(coded, keys, "_v", F.array(*[rank(p) for p in probs]), **how)
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(p).alias("prob"), rank(p).alias("r")) for p in probs]), lambda s: s["r"] == F.col("rank")))
    return found.withColumn("_p", each).select(*keys, "n", F.col("_p.prob").alias("prob"), from_code(F.col("code"), kind).alias(value))


def heavy_keys(df: DataFrame, group: str, key: str, share: float) -> DataFrame:
    """``group``, ``key``, ``n``: the keys that hold at least ``share`` of the rows of their group.

    Rows with a null key count as rows of the group, but null is no key. In the
    order of key hashes the rows of one such key are at least s = floor(share * n)
    in a row, so one of the ranks s, 2s, 3s, ... falls on it: those ranks are
    selected, and the at most 1/share + 1 keys found in each group are counted
    exactly. ``group`` must have few values. Ties in the hash only add candidates.
    """
    exact = Fraction(str(share))
    num, den = exact.numerator, exact.denominator
    hashed = F.expr(f"shiftrightunsigned(xxhash64({key}), 2)")
    codes = cut(df.select(group, F.when(F.col(key).isNull(), F.lit(-1).cast("bigint")).otherwise(hashed).alias("_h")))
    step = F.expr(f"greatest(1, n * {num} div {den})").cast("bigint")
    found = key_ranks(codes, [group], "_h", F.sequence(step, F.greatest(F.col("n"), step), step), buckets=4096, least=step)
    found = cut(found.where(F.col("code") >= 0).select(F.col(group).alias("_g"), F.col("code").alias("_c"), "n").distinct())
    totals = found.select(F.col("_g").alias("_t"), F.col("n").alias("_total")).distinct()
    keyed = df.where(F.col(key).isNotNull()).select(group, key, hashed.alias("_h"))
    hits = keyed.join(F.broadcast(found.select("_g", "_c")), keyed[group].eqNullSafe(F.col("_g")) & (F.col("_h") == F.col("_c")), "left_semi")
    counts = hits.groupBy(group, key).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(totals), counts[group].eqNullSafe(F.col("_t"))).where(F.col("n") * den >= F.col("_total") * num).select(group, key, "n")
