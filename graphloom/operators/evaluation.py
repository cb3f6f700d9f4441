"""Replaced-link data, rankings and accuracy curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.ranking import rank_within, running_within


def replaced_links(old: DataFrame, new: DataFrame, candidates: DataFrame) -> DataFrame:
    """``dab``, ``src``, ``old_links``, ``new_links``: pages that dropped their link to an ambiguous
    page between two snapshots and link to one of its candidates instead.

    ``old`` and ``new`` have ``src``, ``dst``, ``candidates`` has ``dab``, ``candidate``. Only
    ambiguous pages linked to in both snapshots count, candidates of the page are no
    sources, and a case needs a candidate in the new links that is not in the old
    ones. Links are sorted arrays, bounded by the candidates of one page.
    """
    o, n = old.select("src", "dst").distinct(), new.select("src", "dst").distinct()
    dabs = candidates.select("dab").distinct()
    common = dabs.join(o.select(F.col("dst").alias("dab")), "dab", "left_semi").join(n.select(F.col("dst").alias("dab")), "dab", "left_semi")
    before = o.select(F.col("dst").alias("dab"), "src").join(common, "dab", "left_semi")
    after = n.select(F.col("dst").alias("dab"), "src")
    dropped = before.join(after, ["dab", "src"], "left_anti").join(candidates.select("dab", F.col("candidate").alias("src")), ["dab", "src"], "left_anti")
    return _changed(dropped, ["dab"], o, n, candidates.select("dab", "candidate"))


def replaced_labels(old: DataFrame, new: DataFrame, index: DataFrame) -> DataFrame:
    """``text``, ``dab``, ``src``, ``old_links``, ``new_links``: the same for ambiguous labels.

    ``old`` and ``new`` have ``src``, ``dst``, ``labels`` (one row per pair, distinct labels);
    ``index`` the label's targets ``text``, ``dst``. A source counts if it dropped a link
    that had exactly one label and the label leads to several targets.
    """
    o, n = old.select("src", "dst").distinct(), new.select("src", "dst").distinct()
    many = index.groupBy("text").agg(F.count("*").alias("_n")).where("_n > 1").select("text")
    single = old.where(F.size("labels") == 1).select(F.element_at("labels", 1).alias("text"), F.col("dst").alias("dab"), "src").join(many, "text", "left_semi")
    dropped = single.join(n.select("src", F.col("dst").alias("dab")), ["src", "dab"], "left_anti")
    targets = index.select("text", F.col("dst").alias("candidate"))
    return _changed(dropped, ["text", "dab"], o, n, targets)


def _changed(dropped: DataFrame, keys: list[str], o: DataFrame, n: DataFrame, targets: DataFrame) -> DataFrame:
    first = keys[0]
    side = lambda links, name: dropped.join(links.select("src", F.col("dst").alias("candidate")), "src").join(targets, [first, "candidate"]).groupBy(*keys, "src").agg(F.array_sort(F.collect_set("candidate")).alias(name))
    none = F.array().cast("array<string>")
    both = dropped.distinct().join(side(n, "new_links"), [*keys, "src"]).join(side(o, "old_links"), [*keys, "src"], "left")
    both = both.select(*keys, "src", F.coalesce("old_links", none).alias("old_links"), "new_links")
    return both.where(F.size(F.array_except("new_links", "old_links")) > 0)


def rank_classes(scores: DataFrame, ascending: bool = False) -> DataFrame:
    """Adds ``rank`` within each case, 1 for the best score; ties by class index."""
    by = F.col("score").asc() if ascending else F.col("score").desc()
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(by, "class_idx")))


def top_k_hits(ranked: DataFrame, classes: DataFrame, cases: DataFrame, k: int = 1) -> DataFrame:
    """``case_id``, ``score``, ``correct``: whether the members of the best ``k`` classes meet the
    case's new links that are not old ones; ``score`` is the best one."""
    best = ranked.where(F.col("rank") <= k)
    members = best.join(cases.select("case_id", "class_id"), "case_id").join(classes.select("class_id", "class_idx", "member"), ["class_id", "class_idx"])
    guessed = members.groupBy("case_id").agg(F.max("score").alias("score"), F.collect_set("member").alias("_guess"))
    answer = cases.select("case_id", F.array_except("new_links", "old_links").alias("_answer"))
    return answer.join(guessed, "case_id", "left").select("case_id", "score", F.coalesce(F.arrays_overlap("_guess", "_answer"), F.lit(False)).cast("int").alias("correct"))


def skip_cases(cases: DataFrame, n: int) -> DataFrame:
    """The cases after the first ``n`` by case id."""
    return rank_within(cases, [], ["case_id"], "_rank").where(F.col("_rank") > n).drop("_rank")


def accuracy(hits: DataFrame) -> DataFrame:
    """``correct``, ``total``, ``accuracy``: one row; accuracy is 0 without cases."""
    return hits.agg(F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.col("correct") / F.greatest("total", F.lit(1)))


def cumulative_precision(hits: DataFrame) -> DataFrame:
    """``n``, ``precision``: the share of correct ones among the best ``n`` by score, ties by case id."""
    scored = hits.withColumn("_by", -F.coalesce("score", F.lit(float("-inf"))))
    ranked = running_within(scored, [], ["_by", "case_id"], n=("sum", F.lit(1).cast("bigint")), _right=("sum", F.col("correct")))
    return ranked.select("n", (F.col("_right") / F.col("n")).alias("precision"))


def svm_rank_lines(cases: DataFrame, classes: DataFrame, scores: list[DataFrame]) -> DataFrame:
    """``line``: ``target qid:N 1:s 2:s # from -> dab -> titles`` per class of each case, 1 for
    a class that meets the answer and 2 for another."""
    members = classes.groupBy("class_id", "class_idx").agg(F.array_sort(F.collect_set("member")).alias("_m"))
    rows = cases.select("case_id", "class_id", "dab", "src", F.array_except("new_links", "old_links").alias("_a")).join(members, "class_id")
    features = []
    for i, s in enumerate(scores, 1):
        rows = rows.join(s.select("case_id", "class_idx", F.col("score").alias(f"_s{i}")), ["case_id", "class_idx"], "left")
        features.append(F.concat(F.lit(f" {i}:"), F.format_string("%.6f", F.coalesce(f"_s{i}", F.lit(0.0)))))
    target = F.when(F.arrays_overlap("_m", "_a"), "1").otherwise("2")
    line = F.concat(target, F.lit(" qid:"), F.col("case_id").cast("string"), *features, F.lit(" # "), F.col("src"), F.lit(" -> "), F.col("dab"), F.lit(" -> "), F.array_join("_m", ", "))
    return rows.select(line.alias("line"))
