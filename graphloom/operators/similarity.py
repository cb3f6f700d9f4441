"""TF-IDF weights and similarities of documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import tokens
from graphloom.functions.vectors import jaccard
from graphloom.session import cut


def tfidf(bags: DataFrame, counts: DataFrame, n_docs: int, idf: str = "reference", scaled: bool = True, stop_words: list[str] | None = None) -> DataFrame:
    """``doc``, ``term``, ``w``: (1 + ln tf) * ln(N / df), each document scaled to length 1.

    'reference' divides N by df as integers, 'real' as real numbers. ``scaled`` false
    keeps the plain weights. Terms with weight 0 stay; a document of only such terms
    keeps zeros. ``stop_words`` are left out.
    """
    ratio = F.expr(f"{int(n_docs)}L div df") if idf == "reference" else F.lit(float(n_docs)) / F.col("df")
    b = bags.where(~F.col("term").isin(stop_words)) if stop_words else bags
    w = b.join(counts.select("term", "df"), "term").select("doc", "term", ((1 + F.log("n")) * F.log(ratio)).alias("w"))
    if not scaled:
        return w
    norms = w.groupBy(F.col("doc").alias("_d")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return w.join(norms, w["doc"] == norms["_d"]).select("doc", "term", F.when(F.col("_norm") > 0, F.col("w") / F.col("_norm")).otherwise(F.col("w")).alias("w"))


def cosines(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """``a``, ``b``, ``sim``: the dot product of the weights of each given pair; 0 without common terms.
    Only pairs of which both have weights are joined to them."""
    weights = cut(weights.where("w <> 0"))
    left = weights.select(F.col("doc").alias("a"), "term", F.col("w").alias("_wa"))
    right = weights.select(F.col("doc").alias("b"), "term", F.col("w").alias("_wb"))
    p = cut(pairs.select("a", "b").distinct())
    known = weights.select("doc").distinct()
    both = cut(p.join(known.withColumnRenamed("doc", "a"), "a", "left_semi").join(known.withColumnRenamed("doc", "b"), "b", "left_semi"))
    sums = both.join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("sim"))
    return p.join(sums, ["a", "b"], "left").select("a", "b", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def jaccards(pairs: DataFrame, docs: DataFrame, doc: str, text: str, tokenizer: str = "simple") -> DataFrame:
    """``a``, ``b``, ``sim``: the Jaccard similarity of the token sets of each given pair."""
    empty = F.array().cast("array<string>")
    sets = docs.select(F.col(doc).alias("_d"), F.array_distinct(F.coalesce(tokens(F.col(text), tokenizer), empty)).alias("_s"))
    a = sets.select(F.col("_d").alias("a"), F.col("_s").alias("_sa"))
    b = sets.select(F.col("_d").alias("b"), F.col("_s").alias("_sb"))
    return pairs.select("a", "b").distinct().join(a, "a").join(b, "b").select("a", "b", jaccard(F.col("_sa"), F.col("_sb")).alias("sim"))


def neighbour_overlaps(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``a``, ``b``, ``size_a``, ``size_b``, ``overlap``: in-link sets of each given pair.

    ``edges`` has distinct ``src``, ``dst``. Sizes are counted per page. For the overlap a pair meets the in-links
    of the page with fewer, and what it meets is looked up among those of the other, so a hub is
    expanded only in pairs of two hubs. Of these in-links only those of asked pages are joined, no set is gathered in a row, and
    adaptive execution splits the partitions of hubs.
    """
    p = pairs.select("a", "b").distinct()
    n = edges.groupBy("dst").agg(F.count("*").alias("n"))
    zero = F.lit(0)
    sized = p.join(n.select(F.col("dst").alias("a"), F.col("n").alias("_na")), "a", "left").join(n.select(F.col("dst").alias("b"), F.col("n").alias("_nb")), "b", "left")
    sized = cut(sized.select("a", "b", F.coalesce("_na", zero).alias("size_a"), F.coalesce("_nb", zero).alias("size_b")))
    less = F.col("size_a") <= F.col("size_b")
    few, many = F.when(less, F.col("a")).otherwise(F.col("b")), F.when(less, F.col("b")).otherwise(F.col("a"))
    asked = sized.where("size_a > 0 AND size_b > 0").select("a", "b", few.alias("few"), many.alias("many"))
    near = asked.join(edges.select(F.col("dst").alias("few"), F.col("src").alias("_s")), "few").select("a", "b", "many", "_s")
    hits = near.join(edges.select(F.col("dst").alias("many"), F.col("src").alias("_s")), ["many", "_s"])
    both = hits.groupBy("a", "b").agg(F.count("*").alias("_o"))
    return sized.join(both, ["a", "b"], "left").select("a", "b", "size_a", "size_b", F.coalesce("_o", zero).alias("overlap"))
