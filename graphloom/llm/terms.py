"""Term statistics of a text collection: frequencies, bounds and characteristic terms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import skewed_join
from graphloom.session import cut

#: So many hashes of repeated ids are broadcast at most, 8 bytes each.
MOST_REPEATED = 1_000_000


def terms(text: Column) -> Column:
    """The longest letter runs of the lower-cased text; null for null, empty for none."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(0))


def records(df: DataFrame, id: str, text: str) -> DataFrame:
    """``id``, ``text``, ``_t``: one row per id with a non-null text.

    Rows with the same id are one record. Rows without an id are one record per
    distinct text, told apart by ``_t``, which is null for all other rows. Only ids are
    counted; of the texts those of repeated ids alone are shuffled, unless the hashes of these
    are more than ``MOST_REPEATED``, the bound of what is broadcast.
    """
    d = df.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    d = d.withColumn("_t", F.when(F.col("id").isNull(), F.xxhash64("text")))
    key = F.xxhash64("id", "_t")
    repeated = cut(d.groupBy(key.alias("_h")).agg(F.count("*").alias("_n")).where("_n > 1").select("_h"))
    if repeated.count() > MOST_REPEATED:
        return d.dropDuplicates(["id", "_t"])
    d = d.join(F.broadcast(repeated), key == F.col("_h"), "left")
    again = d.where("_h IS NOT NULL").drop("_h").dropDuplicates(["id", "_t"])
    return d.where("_h IS NULL").drop("_h").unionByName(again)


def count_records(df: DataFrame, id: str, text: str) -> int:
    """The number of records; reads ids and, for rows without one, texts."""
    d = df.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.when(F.col(id).isNull(), F.xxhash64(text)).alias("_t"))
    return d.distinct().count()


def record_terms(df: DataFrame, id: str, text: str) -> DataFrame:
    """``id``, ``_t``, ``term``, ``tf``: how often each term occurs in each record.

    A record's terms are sorted and counted within its row, so nothing is shuffled
    for it. Null and empty texts have no rows.
    """
    words = records(df, id, text).select("id", "_t", F.sort_array(terms(F.col("text"))).alias("_w"))
    at = lambda i: F.element_at("_w", i)
    places = F.when(F.size("_w") > 0, F.sequence(F.lit(1), F.size("_w")))
    runs = words.withColumn("_runs", F.filter(places, lambda i: (i == 1) | (at(i) != at(F.greatest(i - 1, F.lit(1))))))
    next_run = lambda k: F.coalesce(F.get("_runs", k + 1), F.size("_w") + 1)
    counted = F.transform("_runs", lambda i, k: F.struct(at(i).alias("term"), (next_run(k) - i).cast("bigint").alias("tf")))
    return runs.select("id", "_t", F.explode(counted).alias("_c")).select("id", "_t", "_c.term", "_c.tf")


def term_frequencies(counts: DataFrame) -> DataFrame:
    """``term``, ``n``, ``records``: occurrences and records of each term of ``record_terms``.

    Both sums are formed per task before the shuffle, so a term in every record
    reaches the final sum as one row per task.
    """
    return counts.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("records"))


def value_frequencies(df: DataFrame, id: str, value: Column) -> DataFrame:
    """``term``, ``n``, ``records`` of a whole-valued column, each id counted once; nulls are left out."""
    one = df.select(F.col(id).alias("id"), value.alias("term")).where(F.col("term").isNotNull()).distinct()
    return one.groupBy("term").agg(F.count("*").alias("n"), F.count("*").alias("records"))


def mark_frequencies(freqs: DataFrame, n_records: int, rare: int = 2, common: float = 0.5) -> DataFrame:
    """Adds ``mark``: 'rare' in at most ``rare`` records, 'common' in at least the share
    ``common`` of ``n_records``, else null. What is both, in tiny collections, is 'rare'."""
    return freqs.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") >= F.lit(common * n_records), "common"))


def term_spread(counts: DataFrame, n_records: int) -> DataFrame:
    """``term``, ``records``, ``n``, ``entropy``, ``presence``: how each term spreads over the records.

    ``entropy`` is the normalised entropy of the term's occurrences over the records
    that have it, H / ln(n_records); ``presence`` the same with each record counted
    once, ln(records) / ln(n_records). Both are 0 in a collection of one record.
    """
    whole = math.log(n_records) if n_records > 1 else 1.0
    agg = counts.groupBy("term").agg(F.count("*").alias("records"), F.sum("tf").alias("n"), F.sum(F.col("tf") * F.log("tf")).alias("_h"))
    h = (F.log("n") - F.col("_h") / F.col("n")) / F.lit(whole)
    return agg.select("term", "records", "n", h.alias("entropy"), (F.log("records") / F.lit(whole)).alias("presence"))


def weigh_terms(counts: DataFrame, n_records: int, local: str = "log", spread: str = "entropy", least: int = 1) -> DataFrame:
    """``id``, ``_t``, ``term``, ``tf``, ``weight`` for the terms in at least ``least`` records.

    Log-entropy weighting by two aggregations, per record and term and then per
    term: weight = local * (1 - spread). ``local`` is 'log' for ln(1 + tf) or 'count'
    for tf; ``spread`` is 'entropy' or 'presence' of ``term_spread``. 'count' with
    'presence' is tf * ln(N / records) / ln(N), the weight of inverse record
    frequency. Weights are rounded to 12 digits, so equal ones compare as equal.
    Terms in most records join by broadcast (see ``skewed_join``), the rest by shuffle.
    """
    total = counts.count()
    stats = cut(term_spread(counts, n_records).where(F.col("records") >= least))
    joined = skewed_join(counts, stats, "term", "records", total)
    near = F.log1p("tf") if local == "log" else F.col("tf").cast("double")
    return joined.select("id", "_t", "term", "tf", F.round(near * (1 - F.col(spread)), 12).alias("weight"))


def most_characteristic(weights: DataFrame) -> DataFrame:
    """``id``, ``_t``, ``term``: the heaviest term of each record, on a tie the first in byte order."""
    best = weights.groupBy("id", "_t").agg(F.min(F.struct((-F.col("weight")).alias("w"), "term")).alias("_b"))
    return best.select("id", "_t", F.col("_b.term").alias("term"))
