"""Word, bag and n-gram counts, and Good-Turing estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import tokens
from graphloom.session import cut


def bag_of_words(docs: DataFrame, doc: str, text: str, tokenizer: str = "simple") -> DataFrame:
    """``doc``, ``term``, ``n``: how often each term occurs in each document."""
    words = docs.select(F.col(doc).alias("doc"), F.explode(tokens(F.col(text), tokenizer)).alias("term"))
    return words.groupBy("doc", "term").agg(F.count("*").alias("n"))


def word_counts(bags: DataFrame) -> DataFrame:
    """``term``, ``df``, ``cf``: documents with the term and its occurrences."""
    return bags.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def word_totals(docs: DataFrame, text: str, tokenizer: str = "simple") -> DataFrame:
    """``documents``, ``words``: one row; documents without a text count as such, with no words."""
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size(F.coalesce(tokens(F.col(text), tokenizer), F.array().cast("array<string>")))), F.lit(0)).cast("bigint").alias("words"))


def bag_lines(bags: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``doc``, ``line``: ``| id:count …`` with ids from 0 in ascending order."""
    d = dictionary.select(F.col("name").alias("_t"), (F.col("id") - 1).alias("_id"))
    rows = bags.join(d, bags["term"] == d["_t"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_id", "n"))), lambda s: F.concat_ws(":", s["_id"].cast("string"), s["n"].cast("string")))
    return rows.groupBy("doc").agg(F.concat(F.lit("| "), F.array_join(parts, " ")).alias("line"))


def trigrams(docs: DataFrame, doc: str, text: str, tokenizer: str = "simple") -> DataFrame:
    """``doc``, ``t1``, ``t2``, ``t3``: three tokens in a row, each occurrence a row."""
    t = docs.select(F.col(doc).alias("doc"), tokens(F.col(text), tokenizer).alias("t")).where(F.size("t") >= 3)
    t = t.select("doc", "t", F.explode(F.sequence(F.lit(1), F.size("t") - 2)).alias("i"))
    return t.select("doc", *[F.element_at("t", F.col("i") + k).alias(f"t{k + 1}") for k in range(3)])


def line_trigrams(lines: DataFrame) -> DataFrame:
    """``doc``, ``t1``, ``t2``, ``t3``: three lines in a row of files with a token per line.

    ``lines`` has ``file``, ``pos``, ``value``; lines meet their successors by position, so a
    file of any size is spread over tasks.
    """
    at = lambda k: lines.select("file", (F.col("pos") - k).alias("pos"), F.col("value").alias(f"t{k + 1}"))
    return at(0).join(at(1), ["file", "pos"]).join(at(2), ["file", "pos"]).select(F.col("file").alias("doc"), "t1", "t2", "t3")


def trigram_counts(grams: DataFrame) -> DataFrame:
    return grams.groupBy("t1", "t2", "t3").agg(F.count("*").alias("n"))


def frequency_of_frequencies(counts: DataFrame, n: str = "n") -> DataFrame:
    """``r``, ``n_r``: how many things occur ``r`` times."""
    return counts.groupBy(F.col(n).alias("r")).agg(F.count("*").alias("n_r"))


def averaged_frequencies(freqs: DataFrame) -> DataFrame:
    """Adds ``z_r`` = 2 N_r / (next r - previous r), with 0 before the first r and 2r - previous
    after the last.

    There are at most as many rows as distinct counts, about the square root of
    twice all occurrences, so they are ordered in one task.
    """
    w = Window.orderBy("r")
    before = F.lag("r", 1, 0).over(w)
    after = F.coalesce(F.lead("r").over(w), 2 * F.col("r") - before)
    return freqs.select("r", "n_r", (2 * F.col("n_r") / (after - before)).alias("z_r"))


def good_turing_table(freqs: DataFrame, mode: str = "reference") -> DataFrame:
    """``r``, ``n_r``, ``p``, ``p0``, ``slope``, ``intercept``: simple Good-Turing from ``r``, ``n_r``, a row per count.

    ``p0`` is the mass of unseen things, ``p`` the probability of a thing that occurs ``r`` times. The Turing
    estimate holds from the least ``r`` as long as the next count occurs and a test passes, the
    smoothed one from the first failure on: with 'reference' both may differ by less than 1.96
    standard deviations, with 'standard' they must differ by more. Like ``averaged_frequencies`` this has
    a row per distinct count. An empty input gives no rows.
    """
    every = Window.partitionBy(F.lit(0))
    order = Window.orderBy("r")
    z = averaged_frequencies(freqs)
    x, y = F.log("r"), F.log("z_r")
    mean_x, mean_y = F.avg(x).over(every), F.avg(y).over(every)
    z = z.withColumns({"_x": x - mean_x, "_y": y - mean_y, "_mx": mean_x, "_my": mean_y})
    z = z.withColumn("slope", F.coalesce(F.try_divide(F.sum(F.col("_x") * F.col("_y")).over(every), F.sum(F.col("_x") * F.col("_x")).over(every)), F.lit(0.0)))
    z = z.withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    smooth = (F.col("r") + 1) * F.exp(F.col("slope") * (F.log(F.col("r") + 1) - F.log("r")))
    following = F.when(F.lead("r").over(order) == F.col("r") + 1, F.lead("n_r").over(order))
    ratio = following / F.col("n_r")
    z = z.withColumns({"_smooth": smooth, "_raw": (F.col("r") + 1) * ratio, "_limit": 1.96 * (F.col("r") + 1) / F.col("n_r") * F.sqrt(following * (1 + ratio))})
    near = F.abs(F.col("_raw") - F.col("_smooth")) < F.col("_limit")
    passed = F.coalesce(near if mode == "reference" else ~near, F.lit(False))
    z = z.withColumn("_passed", passed)
    star = F.when(F.min("_passed").over(order), F.col("_raw")).otherwise(F.col("_smooth"))
    z = z.withColumns({"_star": star, "p0": F.coalesce(F.max(F.when(F.col("r") == 1, F.col("n_r"))).over(every), F.lit(0)) / F.sum(F.col("r") * F.col("n_r")).over(every)})
    p = (1 - F.col("p0")) * F.col("_star") / F.sum(F.col("n_r") * F.col("_star")).over(every)
    return z.select("r", "n_r", p.alias("p"), "p0", "slope", "intercept")


def good_turing(freqs: DataFrame, mode: str = "reference") -> dict:
    """``good_turing_table`` as ``p0``, ``slope``, ``intercept`` and ``p``, the probabilities by r. An empty input has p0 = 0."""
    rows = good_turing_table(freqs, mode).collect()  # distinct counts only
    first = rows[0].asDict() if rows else {"p0": 0.0, "slope": 0.0, "intercept": 0.0}
    return {**{k: first[k] for k in ("p0", "slope", "intercept")}, "p": {r["r"]: r["p"] for r in rows}}


def classify(docs: DataFrame, first: DataFrame, second: DataFrame, doc: str, text: str, tokenizer: str = "simple", mode: str = "reference") -> DataFrame:
    """``doc``, ``score``, ``label``: which of two reference corpora each document is more like.

    The score is the difference of its trigrams' log likelihoods under both
    Good-Turing models; 'First' above 0, 'Second' below, else 'same'.
    """
    models = []
    words = first.select(text).unionByName(second.select(text)).unionByName(docs.select(text)).select(F.explode(tokens(F.col(text), tokenizer)).alias("w"))
    vocabulary = max(words.distinct().count(), 1)
    for corpus in (first, second):
        counts = cut(trigram_counts(trigrams(corpus, doc, text, tokenizer)))
        m = good_turing(frequency_of_frequencies(counts), mode)
        unseen = max(vocabulary**3 - counts.count(), 1)
        by_r = docs.sparkSession.createDataFrame(list(m["p"].items()), "n bigint, p double")  # a row per distinct count
        known = counts.join(F.broadcast(by_r), "n").select("t1", "t2", "t3", "p")
        models.append((known, max(m["p0"], 1e-300) / unseen))
    grams = trigram_counts_by_doc(trigrams(docs, doc, text, tokenizer))
    for k, (known, low) in enumerate(models):
        grams = grams.join(known.withColumnRenamed("p", f"p{k}"), ["t1", "t2", "t3"], "left").withColumn(f"p{k}", F.coalesce(f"p{k}", F.lit(low)))
    scores = grams.groupBy("doc").agg(F.sum(F.col("n") * (F.log("p0") - F.log("p1"))).alias("score"))
    out = docs.select(F.col(doc).alias("doc")).distinct().join(scores, "doc", "left").select("doc", F.coalesce("score", F.lit(0.0)).alias("score"))
    return out.withColumn("label", F.when(F.col("score") > 0, "First").when(F.col("score") < 0, "Second").otherwise("same"))


def trigram_counts_by_doc(grams: DataFrame) -> DataFrame:
    return grams.groupBy("doc", "t1", "t2", "t3").agg(F.count("*").alias("n"))
