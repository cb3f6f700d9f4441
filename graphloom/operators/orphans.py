"""References to records that do not exist, told apart by the parents' validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranking import running_within

FOREVER = "9999-12-31 00:00:00"
#: Records of the stream, in this order where times are equal.
KNOWN, BEGUN, REFERENCE = 0, 1, 2


def find_orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """``tab``, ``rec_id``, ``period``, ``state`` of each reference without a parent at its time.

    ``references`` has ``tab``, ``rec_id``, ``key``, ``at``; ``parents`` has ``tab``,
    ``key``, ``valid_from``, ``valid_to`` (null: still valid), ``at`` and the bounds
    being timestamps without zone. A reference is served if a parent of its key has
    ``valid_from`` <= ``at`` < ``valid_to``. The others are 'missing' (the key has no
    parent at all), 'late' (a parent begins after ``at``) or 'deleted'. ``period``
    is the month of ``at``.

    Null keys aren't looked at. Repeated references come out once, repeated parents
    count once. A parent without ``valid_from`` is never valid but makes its key
    known; a reference without a time is served by no parent, has a null period
    and is 'missing' or 'deleted'. Empty tables give an empty result; without
    parents every reference is 'missing'.

    References and parents form one stream, partitioned by key, sorted by time
    and merged in one pass: the running maximum of ``valid_to`` over the
    parents that began so far tells whether one of them is valid, and a first record
    of each parent, before all times, carries its beginning. A key with very many references or
    parents is split by time, and where times are equal by ``rec_id`` (see ``running_within``).
    """
    none = F.lit(None).cast("timestamp_ntz")
    refs = references.where(F.col("key").isNotNull()).select("tab", "key", F.col("at").cast("timestamp_ntz").alias("_at"), F.lit(REFERENCE).alias("_kind"), none.alias("_v"), "rec_id")
    begin, end = F.col("valid_from").cast("timestamp_ntz"), F.coalesce(F.col("valid_to").cast("timestamp_ntz"), F.lit(FOREVER).cast("timestamp_ntz"))
    record = lambda at, kind, v: F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), v.alias("_v"))
    both = F.filter(F.array(record(none, KNOWN, begin), record(begin, BEGUN, end)), lambda r: (r["_kind"] == KNOWN) | r["_at"].isNotNull())
    spans = parents.where(F.col("key").isNotNull()).select("tab", "key", F.explode(both).alias("_r"), F.xxhash64(begin, end).alias("rec_id"))
    stream = refs.unionByName(spans.select("tab", "key", "_r.*", "rec_id"))
    of = lambda kind: ("max", F.when(F.col("_kind") == kind, F.col("_v")))
    merged = running_within(stream, ["tab", "key"], ["_at", "_kind", "rec_id"], _seen=("max", F.when(F.col("_kind") < REFERENCE, True)), _latest=of(KNOWN), _until=of(BEGUN))
    served = F.coalesce(F.col("_until") > F.col("_at"), F.lit(False))
    state = F.when(F.col("_seen").isNull(), "missing").when(F.col("_latest") > F.col("_at"), "late").otherwise("deleted")
    orphans = merged.where((F.col("_kind") == REFERENCE) & ~served)
    return orphans.select("tab", "rec_id", F.date_format("_at", "yyyy-MM").alias("period"), state.alias("state")).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """``tab``, ``period``, ``state``, ``n``: orphan references counted per table and month."""
    return orphans.groupBy("tab", "period", "state").agg(F.count("*").alias("n"))
