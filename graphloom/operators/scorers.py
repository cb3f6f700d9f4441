"""Scorers of the classes an ambiguous link may mean, by name.

A scorer takes a ``Context``, cases (``case_id``, ``class_id``, ``dab``, ``text``, ``src``) and
classes (``class_id``, ``class_idx``, ``member``) and gives ``case_id``, ``class_idx``, ``score``,
the higher the better, one row for each class of each case.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.vectors import DIVERGENCES, relatedness, to_distribution
from graphloom.operators import counting, similarity
from graphloom.operators.walk import exact_walks
from graphloom.session import cut

#: What a page without a topic vector gets.
VECTOR_LENGTH = 100
ARTICLES = 3_900_000


@dataclass
class Context:
    """Inputs of the scorers; each needs only some of them.

    ``links``: src, dst, text, a row per label; ``graph``: src, dst, a row per link, also those
    without labels (else ``links`` serves); ``docs``: title, text; ``vectors``: title, vec;
    ``samples``: doc, dab, cand, p.
    """

    links: DataFrame | None = None
    docs: DataFrame | None = None
    vectors: DataFrame | None = None
    samples: DataFrame | None = None
    graph: DataFrame | None = None
    options: dict = field(default_factory=dict)

    @cached_property
    def edges(self) -> DataFrame:
        return cut((self.graph if self.graph is not None else self.links).select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())

    def weights(self, tokenizer: str = "simple", **how) -> DataFrame:
        bags = counting.bag_of_words(self.docs, "title", "text", tokenizer)
        return similarity.tfidf(bags, counting.word_counts(bags), self.docs.select("title").distinct().count(), **how)


Scorer = Callable[[Context, DataFrame, DataFrame], DataFrame]
SCORERS: dict[str, Scorer] = {}


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    def add(f: Scorer) -> Scorer:
        SCORERS[name] = f
        return f

    return add


def members_of(cases: DataFrame, classes: DataFrame) -> DataFrame:
    """Every candidate of every class of every case."""
    return cases.select("case_id", "class_id", "dab", "src", *[c for c in ("text",) if c in cases.columns]).join(classes.select("class_id", "class_idx", "member"), "class_id")


def best_of(members: DataFrame, score: Column) -> DataFrame:
    return members.groupBy("case_id", "class_idx").agg(F.max(score).alias("score"))


def share(scores: DataFrame) -> DataFrame:
    """Each score over the sum of its case, or over 1 where that is 0."""
    s = F.sum("score").over(Window.partitionBy("case_id"))
    return scores.select("case_id", "class_idx", (F.col("score") / F.when(s == 0, 1).otherwise(s)).alias("score"))


@scorer("baseline")
def baseline(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """The share of the distinct in-links of each class.

    In-links are counted once per page; only those of classes with several members are joined to their
    classes, to count what the members share once.
    """
    c = cut(classes.select("class_id", "class_idx", "member").distinct())
    e = ctx.edges
    sizes = c.groupBy("class_id", "class_idx").agg(F.count("*").alias("_k"), F.min("member").alias("member"))
    degrees = e.groupBy(F.col("dst").alias("_d")).agg(F.count("*").alias("_n"))
    one = sizes.where("_k < 2").join(degrees, F.col("member") == F.col("_d"), "left").select("class_id", "class_idx", F.coalesce("_n", F.lit(0)).alias("n"))
    many = sizes.where("_k > 1").select("class_id", "class_idx").join(c, ["class_id", "class_idx"])
    if many.isEmpty():
        n = one
    else:
        n = one.unionByName(many.join(e, many["member"] == e["dst"], "left").groupBy("class_id", "class_idx").agg(F.count_distinct("src").alias("n")))
    n = cut(n)
    whole = n.groupBy("class_id").agg(F.sum("n").alias("_all"))
    n = n.join(whole, "class_id").select("class_id", "class_idx", (F.col("n") / F.greatest("_all", F.lit(1))).alias("score"))
    return cases.select("case_id", "class_id").join(n, "class_id").select("case_id", "class_idx", "score")


@scorer("link_text")
def link_text(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """The share of the occurrences of the case's label that lead to each class."""
    n = ctx.links.groupBy(F.col("dst").alias("member"), F.col("text").alias("text")).agg(F.count("*").alias("n"))
    m = members_of(cases, classes).join(n, ["member", "text"], "left")
    return share(m.groupBy("case_id", "class_idx").agg(F.sum(F.coalesce("n", F.lit(0))).alias("score")))


def _pairs(m: DataFrame) -> DataFrame:
    return m.select(F.col("src").alias("a"), F.col("member").alias("b")).distinct()


def _best_similarity(m: DataFrame, sims: DataFrame) -> DataFrame:
    return best_of(m.join(sims, (m["src"] == sims["a"]) & (m["member"] == sims["b"]), "left"), F.coalesce("sim", F.lit(0.0)))


@scorer("tfidf")
def tfidf(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """The greatest cosine of a candidate's text with the source's."""
    m = members_of(cases, classes)
    how = {k: ctx.options[k] for k in ("idf", "scaled", "stop_words") if k in ctx.options}
    return _best_similarity(m, similarity.cosines(_pairs(m), ctx.weights(ctx.options.get("tokenizer", "simple"), **how)))


@scorer("tfidf_plain")
def tfidf_plain(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """The same without scaling to length 1 and without common words."""
    m = members_of(cases, classes)
    return _best_similarity(m, similarity.cosines(_pairs(m), ctx.weights(scaled=False, stop_words=ctx.options.get("stop_words"))))


@scorer("jaccard")
def jaccard(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """The greatest Jaccard similarity of the texts' token sets."""
    m = members_of(cases, classes)
    return _best_similarity(m, similarity.jaccards(_pairs(m), ctx.docs, "title", "text", ctx.options.get("tokenizer", "simple")))


@scorer("jaccard_latin")
def jaccard_latin(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    m = members_of(cases, classes)
    return _best_similarity(m, similarity.jaccards(_pairs(m), ctx.docs, "title", "text", "latin"))


@scorer("out_links")
def out_links(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """TF-IDF with the pages linked to as terms."""
    graph = ctx.graph if ctx.graph is not None else ctx.links
    bags = graph.select(F.col("src").alias("doc"), F.col("dst").alias("term")).where("term IS NOT NULL").groupBy("doc", "term").agg(F.count("*").alias("n"))
    weights = similarity.tfidf(bags, counting.word_counts(bags), ctx.edges.select("src").distinct().count())
    m = members_of(cases, classes)
    return _best_similarity(m, similarity.cosines(_pairs(m), weights))


@scorer("relatedness")
def link_relatedness(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """How related the source's neighbours are to the candidates by shared in-links.

    The neighbours are the pages the source links to, without the ambiguous page, and
    the source. Their scores combine by ``combine``: 'max', 'mean' or a quantile. A class
    with the ambiguous page gets -999, a candidate that is the source 0, and a pair of
    the same page counts 0.
    """
    how = ctx.options.get("combine", "max")
    m = members_of(cases, classes)
    e = ctx.edges
    out = cases.select("case_id", "src", "dab").join(e.select("src", F.col("dst").alias("near")), "src").where("near <> dab").select("case_id", "near")
    near = out.unionByName(cases.select("case_id", F.col("src").alias("near"))).distinct()
    pairs = m.select("case_id", "class_idx", "member", "src", "dab").join(near, "case_id")
    o = similarity.neighbour_overlaps(pairs.where("near <> member").select(F.col("near").alias("a"), F.col("member").alias("b")), e)
    r = o.select("a", "b", relatedness(F.col("size_a"), F.col("size_b"), F.col("overlap"), ctx.options.get("articles", ARTICLES), ctx.options.get("smoothing", 0.0)).alias("r"))
    scored = pairs.join(r, (pairs["near"] == r["a"]) & (pairs["member"] == r["b"]), "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    if how == "max":
        one = F.max("r")
    elif how == "mean":
        one = F.avg("r")
    else:
        all_ = F.array_sort(F.collect_list("r"))
        one = F.element_at(all_, F.least(F.floor(F.size(all_) * F.lit(float(how))) + 1, F.size(all_)).cast("int"))
    each = scored.groupBy("case_id", "class_idx", "member", "src", "dab").agg(one.alias("r"))
    each = each.withColumn("r", F.when(F.col("member") == F.col("src"), 0.0).otherwise(F.col("r")))
    flagged = each.groupBy("case_id", "class_idx").agg(F.max("r").alias("_r"), F.max(F.col("member") == F.col("dab")).alias("_dab"))
    return flagged.select("case_id", "class_idx", F.when(F.col("_dab"), -999.0).otherwise(F.col("_r")).alias("score"))


@scorer("lda")
def lda(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """The negated least divergence of a candidate's topic vector from the source's, or with the
    option ``neighbors`` from those of the pages it links to. The ambiguous page and
    pages without a vector count as uniform."""
    size = ctx.options.get("length", VECTOR_LENGTH)
    uniform = F.array_repeat(F.lit(1.0 / size), size)
    v = ctx.vectors.select(F.col("title").alias("_t"), to_distribution(F.col("vec")).alias("_v"))
    m = members_of(cases, classes)
    if ctx.options.get("neighbors"):
        m = m.join(ctx.edges.select(F.col("src").alias("_from"), F.col("dst").alias("near")), m["src"] == F.col("_from")).where("near <> dab").drop("_from")
    else:
        m = m.withColumn("near", F.col("src"))
    m = m.join(v.select(F.col("_t").alias("_ta"), F.col("_v").alias("_va")), F.col("near") == F.col("_ta"), "left").join(v.select(F.col("_t").alias("_tb"), F.col("_v").alias("_vb")), F.col("member") == F.col("_tb"), "left")
    a = F.coalesce("_va", uniform)
    b = F.when(F.col("member") == F.col("dab"), uniform).otherwise(F.coalesce("_vb", uniform))
    return best_of(m, -DIVERGENCES[ctx.options.get("divergence", "kl")](a, b))


def _walk_scores(ctx: Context, cases: DataFrame, classes: DataFrame, edges: DataFrame, alpha: float, tol: float) -> DataFrame:
    starts = cases.select(F.col("src").alias("start"), F.col("dab").alias("without")).distinct()
    walks = exact_walks(edges, starts, alpha, tol, reenter=False)
    m = members_of(cases, classes)
    return m.join(walks, (m["src"] == walks["start"]) & m["dab"].eqNullSafe(walks["without"]) & (m["member"] == walks["node"]), "left").withColumn("_w", F.coalesce("score", F.lit(0.0))).select(*m.columns, "_w")


@scorer("walk")
def walk(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """The greatest score of a candidate in the walk from the source without the ambiguous page;
    with the option ``bayes`` times the share of the candidate's links that have the label."""
    m = _walk_scores(ctx, cases, classes, ctx.edges, ctx.options.get("alpha", 0.5), ctx.options.get("tol", 1e-7))
    if not ctx.options.get("bayes"):
        return best_of(m, F.col("_w"))
    n = ctx.links.groupBy(F.col("dst").alias("_d"), F.col("text").alias("_x")).agg(F.count("*").alias("_n"))
    whole = n.groupBy(F.col("_d").alias("_e")).agg(F.sum("_n").alias("_all"))
    m = m.join(n, (m["member"] == n["_d"]) & (m["text"] == n["_x"]), "left").join(whole, F.col("member") == F.col("_e"), "left")
    return best_of(m, F.col("_w") * F.coalesce(F.col("_n") / F.col("_all"), F.lit(0.0)))


@scorer("walk_radius")
def walk_radius(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """The negated mean divergence of the walks from the source and from a candidate from their
    average, both without the ambiguous page; the greatest of a class. The source's walk
    has the option ``tol``, the candidates' ``candidate_tol``."""
    m = members_of(cases, classes)

    def spread(page: str, tol: float) -> DataFrame:
        starts = m.select(F.col(page).alias("start"), F.col("dab").alias("without")).where("start <> without").distinct()
        w = cut(exact_walks(ctx.edges, starts, ctx.options.get("alpha", 0.5), tol, reenter=False))
        return w.join(w.groupBy("start", "without").agg(F.sum("score").alias("_all")), ["start", "without"]).select("start", "without", "node", (F.col("score") / F.col("_all")).alias("p"))

    near, far = spread("src", ctx.options.get("tol", 1e-7)), spread("member", ctx.options.get("candidate_tol", 1e-4))
    pairs = m.select("src", "member", F.col("dab").alias("without")).distinct()
    a = pairs.join(near.select(F.col("start").alias("src"), "without", "node", F.col("p").alias("a")), ["src", "without"])
    b = pairs.join(far.select(F.col("start").alias("member"), "without", "node", F.col("p").alias("b")), ["member", "without"])
    both = a.join(b, ["src", "member", "without", "node"], "full")
    x, y = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    part = F.when(x > 0, x * F.log(2 * x / (x + y))).otherwise(0.0) + F.when(y > 0, y * F.log(2 * y / (x + y))).otherwise(0.0)
    radius = both.groupBy("src", "member", "without").agg((-F.sum(part) / 2).alias("_s"))
    scored = m.join(radius, (m["src"] == radius["src"]) & (m["member"] == radius["member"]) & (m["dab"] == radius["without"]), "left")
    return scored.groupBy("case_id", "class_idx").agg(F.max(F.coalesce("_s", F.lit(-math.log(2)))).alias("score"))


def _weighted(ctx: Context, similar: str) -> DataFrame:
    e = ctx.edges
    pairs = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    sims = similarity.cosines(pairs, ctx.weights()) if similar == "tfidf" else similarity.jaccards(pairs, ctx.docs, "title", "text")
    return sims.where("sim > 0").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("sim").alias("weight"))


@scorer("tfidf_walk")
def tfidf_walk(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """The walk with the cosine of both pages' texts as the weight of a link."""
    m = _walk_scores(ctx, cases, classes, cut(_weighted(ctx, "tfidf")), ctx.options.get("alpha", 0.5), ctx.options.get("tol", 0.01))
    return best_of(m, F.col("_w"))


@scorer("jaccard_walk")
def jaccard_walk(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    m = _walk_scores(ctx, cases, classes, cut(_weighted(ctx, "jaccard")), ctx.options.get("alpha", 0.5), ctx.options.get("tol", 0.01))
    return best_of(m, F.col("_w"))


@scorer("gibbs")
def gibbs(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """The greatest averaged probability of a candidate; a certain one counts 0, like a missing one."""
    s = ctx.samples.select(F.col("doc").alias("src"), "dab", F.col("cand").alias("member"), "p")
    m = members_of(cases, classes).join(s, ["src", "dab", "member"], "left")
    return best_of(m, F.when(F.col("p") == 1.0, 0.0).otherwise(F.coalesce("p", F.lit(0.0))))


@scorer("tfidf_in_links")
def tfidf_in_links(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """The greatest cosine of the source with a class's members or a sample of their in-links,
    the first ``sample`` (100) by hash, so that the sample is the same each time."""
    k = ctx.options.get("sample", 100)
    c = classes.select("class_id", "class_idx", "member").distinct()
    e = ctx.edges
    first = Window.partitionBy("dst").orderBy(F.md5("src"), "src")
    least = e.join(c.select(F.col("member").alias("dst")).distinct(), "dst", "left_semi").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select(F.col("dst").alias("member"), F.col("src").alias("page"))  # a class's first are among its members' first
    near = c.join(least, "member").select("class_id", "class_idx", "page").distinct()
    w = Window.partitionBy("class_id", "class_idx").orderBy(F.md5("page"), "page")
    near = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r").unionByName(c.withColumnRenamed("member", "page")).distinct()
    m = cases.select("case_id", "class_id", "src").join(near.withColumnRenamed("page", "member"), "class_id")
    return _best_similarity(m, similarity.cosines(_pairs(m), ctx.weights()))


def weighted(parts: dict[str, float]) -> Scorer:
    """The weighted sum of other scorers."""

    def run(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
        all_ = None
        for name, w in parts.items():
            s = SCORERS[name](ctx, cases, classes).select("case_id", "class_idx", (F.col("score") * F.lit(float(w))).alias("score"))
            all_ = s if all_ is None else all_.unionByName(s)
        return all_.groupBy("case_id", "class_idx").agg(F.sum("score").alias("score"))

    return run


@scorer("svm")
def svm(ctx: Context, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """A linear support vector machine that tells right classes from wrong ones by other scorers.

    Fitted on the cases with an answer (``new_links``, ``old_links``) by the option
    ``features``, names of scorers; the score is the margin.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = ctx.options.get("features", ["baseline", "link_text"])
    rows = members_of(cases, classes).groupBy("case_id", "class_idx").agg(F.collect_set("member").alias("_m"))
    for n in names:
        rows = rows.join(SCORERS[n](ctx, cases, classes).withColumnRenamed("score", n), ["case_id", "class_idx"], "left").fillna(0.0, [n])
    answers = cases.select("case_id", F.array_except("new_links", "old_links").alias("_a"))
    rows = cut(rows.join(answers, "case_id").withColumn("label", F.arrays_overlap("_m", "_a").cast("double")).fillna(0.0, ["label"]))
    data = VectorAssembler(inputCols=names, outputCol="x").transform(rows)
    if data.select("label").distinct().count() < 2:
        return rows.select("case_id", "class_idx", F.lit(0.0).alias("score"))
    model = LinearSVC(featuresCol="x", labelCol="label", maxIter=20, regParam=0.01).fit(data)
    return model.transform(data).select("case_id", "class_idx", vector_to_array("rawPrediction")[1].alias("score"))


def sparse_kl(a: DataFrame, b: DataFrame, key: str, value: str) -> float:
    """KL divergence of two score tables scaled to 1; infinite where ``b`` misses a key of ``a``."""
    total = lambda d: d.agg(F.sum(value)).first()[0] or 1.0
    sa, sb = total(a), total(b)
    x = a.select(key, (F.col(value) / sa).alias("_x")).where("_x > 0").join(b.select(key, (F.col(value) / sb).alias("_y")), key, "left")
    return x.agg(F.sum(F.when(F.coalesce("_y", F.lit(0.0)) == 0, F.lit(math.inf)).otherwise(F.col("_x") * F.log(F.col("_x") / F.col("_y"))))).first()[0] or 0.0
