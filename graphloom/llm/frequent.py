"""The most frequent values of a column in bounded memory.

A heavy part of buckets counts ``WAYS`` values each, exactly while they stay; the
least value of a bucket is put out when the votes against the bucket outnumber its
count ``VOTES`` times, and its count goes to a light part, an array of counters
shared by all values. Tasks build such pairs over their own rows; pairs merge
bucket by bucket and counter by counter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import cut

VOTES = 8
WAYS = 4
BUCKETS = 2048
SLOTS = 32768
#: Rows gathered before they are counted together.
CHUNK = 1 << 18
#: How often the buckets are quadrupled before exact counting of all values takes over.
GROWTHS = 3


class Sketch:
    """One task's heavy and light part for one group."""

    def __init__(self, buckets: int, slots: int) -> None:
        self.key = np.zeros((buckets, WAYS), np.int64)
        self.pos = np.zeros((buckets, WAYS), np.int64)
        self.neg = np.zeros(buckets, np.int64)
        self.light = np.zeros(slots, np.int64)

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) >> np.uint64(20)) % np.uint64(len(self.light))).astype(np.int64)

    def put_out(self, codes: np.ndarray, counts: np.ndarray) -> None:
        np.add.at(self.light, self.slot(codes), counts)

    def add(self, codes: np.ndarray) -> None:
        code, n = np.unique(codes, return_counts=True)
        at = (code % len(self.key)).astype(np.int64)
        held = (self.key[at] == code[:, None]) & (self.pos[at] > 0)
        own = held.any(axis=1)
        self.pos[at[own], held[own].argmax(axis=1)] += n[own]
        code, n, at = code[~own], n[~own], at[~own]
        # The others challenge their bucket, the most frequent first; one of each bucket at a time.
        order = np.lexsort((-n, at))
        code, n, at = code[order], n[order], at[order]
        begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        turn = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
        for k in range(2 * WAYS):
            now = turn == k
            if not now.any():
                break
            self._challenge(at[now], code[now], n[now])
        late = turn >= 2 * WAYS
        np.add.at(self.neg, at[late], n[late])
        self.put_out(code[late], n[late])

    def _challenge(self, b: np.ndarray, code: np.ndarray, n: np.ndarray) -> None:
        """One challenger for each of some buckets."""
        way = self.pos[b].argmin(axis=1)  # a free one has 0
        least = self.pos[b, way]
        self.neg[b] += np.where(least == 0, 0, n)
        takes = (least == 0) | (self.neg[b] >= VOTES * least)
        falls = takes & (least > 0)
        self.put_out(self.key[b[falls], way[falls]], least[falls])
        self.neg[b[falls]] = 1
        self.key[b[takes], way[takes]], self.pos[b[takes], way[takes]] = code[takes], n[takes]
        self.put_out(code[~takes], n[~takes])


SKETCH_SCHEMA = "group string, heavy boolean, at bigint, code bigint, n bigint"


def _sketches(buckets: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Sketch] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def flush(g: str) -> None:
            if waiting.get(g):
                made.setdefault(g, Sketch(buckets, slots)).add(np.concatenate(waiting[g]))
            waiting[g] = []

        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            index = groups.indices.to_numpy(zero_copy_only=False)
            codes = batch.column(1).to_numpy(zero_copy_only=False)
            for i, g in enumerate(groups.dictionary.to_pylist()):
                waiting.setdefault(g, []).append(codes[index == i])
                if sum(map(len, waiting[g])) >= CHUNK:
                    flush(g)
        for g in list(waiting):
            flush(g)
        for g, s in made.items():
            h, lit = np.nonzero(s.pos), np.flatnonzero(s.light)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * (len(h[0]) + len(lit)), pa.string()), pa.array(np.r_[np.ones(len(h[0]), bool), np.zeros(len(lit), bool)]), pa.array(np.r_[h[0], lit]), pa.array(np.r_[s.key[h], np.zeros(len(lit), np.int64)]), pa.array(np.r_[s.pos[h], s.light[lit]])],
                names=["group", "heavy", "at", "code", "n"],
            )

    return run


def heavy_light(df: DataFrame, group: str, key: str, buckets: int = BUCKETS, slots: int = SLOTS) -> DataFrame:
    """``group``, ``code``, ``low``, ``high``: the values in the merged buckets, by the hash
    ``xxhash64(key)``, with bounds of their counts.

    ``low`` is what buckets counted, ``high`` adds the value's counter of the light
    part. A row with a null ``code`` per group has in ``high`` the largest counter:
    no value outside the buckets occurs more often. Null keys are left out. ``group``
    must have few values. Memory per task and the result's size depend on ``buckets``
    and ``slots`` only.
    """
    codes = df.where(F.col(key).isNotNull()).select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("group"), F.xxhash64(key).alias("code"))
    parts = cut(codes.mapInArrow(_sketches(buckets, slots), SKETCH_SCHEMA))
    heavy = parts.where("heavy").groupBy("group", "at", "code").agg(F.sum("n").alias("n"))
    ranked = heavy.withColumn("_r", F.row_number().over(Window.partitionBy("group", "at").orderBy(F.col("n").desc(), "code")))
    slot = F.expr(f"pmod(shiftrightunsigned(code, 20), {slots})")
    lost = ranked.where(F.col("_r") > WAYS).select("group", slot.alias("at"), "n")
    light = parts.where("not heavy").select("group", "at", "n").unionByName(lost).groupBy("group", "at").agg(F.sum("n").alias("light"))
    light = light.select(F.col("group").alias("_g"), F.col("at").alias("_s"), "light")
    kept = ranked.where(F.col("_r") <= WAYS).select("group", "code", F.col("n").alias("low"), slot.alias("slot"))
    bounds = kept.join(light, (kept["group"] == light["_g"]) & (kept["slot"] == light["_s"]), "left").select("group", "code", "low", (F.col("low") + F.coalesce("light", F.lit(0))).alias("high"))
    rest = light.groupBy(F.col("_g").alias("group")).agg(F.lit(None).cast("bigint").alias("code"), F.lit(0).cast("bigint").alias("low"), F.max("light").alias("high"))
    return bounds.unionByName(rest)


def top_values(df: DataFrame, group: str, key: str, k: int = 10, buckets: int = BUCKETS, slots: int = SLOTS) -> DataFrame:
    """``group``, ``key``, ``low``, ``high``, ``n``: per group the ``k`` most frequent values.

    ``low`` and ``high`` are the bounds of ``heavy_light``, ``n`` the exact count of
    the values that can be among the ``k`` by these bounds, from one more pass. On
    equal counts the first key in byte order comes first. Nothing is missed: if the
    k-th count doesn't exceed the largest counter of the light part, the buckets are
    quadrupled, and after ``GROWTHS`` times all values are counted exactly, with
    ``low`` = ``high`` = ``n``. Null keys are left out; an empty input gives no rows.
    """
    keyed = df.where(F.col(key).isNotNull()).select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("group"), F.col(key).alias("key"))
    by_low = Window.partitionBy("group").orderBy(F.col("low").desc())
    by_n = Window.partitionBy("group").orderBy(F.col("n").desc(), "key")
    for growth in range(GROWTHS + 1):
        size = 4**growth
        bounds = cut(heavy_light(df, group, key, buckets * size, slots * size))
        # At most WAYS rows per bucket and group, so these few lines are bounded.
        last = {r["group"]: (r["low"], r["r"]) for r in bounds.where("code IS NOT NULL").withColumn("r", F.row_number().over(by_low)).where(F.col("r") <= k).groupBy("group").agg(F.min("low").alias("low"), F.max("r").alias("r")).collect()}
        rest = {r["group"]: r["high"] for r in bounds.where("code IS NULL").collect()}
        if all(rest.get(g, 0) == 0 or (r == k and low > rest[g]) for g, (low, r) in last.items()):
            least = F.lit(0).cast("bigint")
            for g, (low, r) in last.items():
                least = F.when(F.col("group") == g, F.lit(low if r == k else 0)).otherwise(least)
            able = F.broadcast(bounds.where(F.col("code").isNotNull() & (F.col("high") >= least)).select(F.col("group").alias("_g"), F.col("code").alias("_c"), "low", "high"))
            hits = keyed.join(able, (keyed["group"] == able["_g"]) & (F.xxhash64(keyed["key"]) == able["_c"]))
            counted = hits.groupBy("group", "key").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.count("*").alias("n"))
            break
    else:
        counted = keyed.groupBy("group", "key").agg(F.count("*").alias("n")).select("group", "key", F.col("n").alias("low"), F.col("n").alias("high"), "n")
    return counted.withColumn("_r", F.row_number().over(by_n)).where(F.col("_r") <= k).drop("_r")
