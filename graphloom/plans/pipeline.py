"""The pipeline from dumps to scores: each stage reads relations of a catalog and writes others."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import normal_label
from graphloom.functions.wikitext import LONGEST_TITLE, admitted_links, dab_template, extract_links, is_redirect, links_to_text, list_lines, redirect_target, resolve_titles, split_title, strip_wiki_column
from graphloom.operators import counting, dictionary, evaluation, links as L, scorers, topics
from graphloom.operators.lda import topic_vectors
from graphloom.operators.ranking import rank_within
from graphloom.operators.walk import exact_walks
from graphloom.session import cut
from graphloom.sources import dump


@dataclass
class Catalog:
    """Relations as Parquet below one folder, sorted by their keys."""

    spark: SparkSession
    root: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def write(self, name: str, df: DataFrame, *keys: str) -> DataFrame:
        dump.write_sorted(df, f"{self.root}/{name}", *keys, mode="overwrite")
        return self.read(name)


def build_database(c: Catalog, dumps: str) -> None:
    """``namespaces`` and ``pages`` (title, text) of all dumps below a folder."""
    c.write("namespaces", dump.effective_namespaces(dump.read_namespaces(c.spark, dumps)).where("main OR name <> ''"), "lang", "ns_id")
    pages = dump.read_pages(c.spark, dumps)
    c.write("pages", pages.select(F.concat_ws(":", "lang", "title").alias("title"), "text"), "title")


def _names(c: Catalog) -> DataFrame:
    return c.read("namespaces").select("lang", "ns_id", "name")


def _own_links(c: Catalog, pages: DataFrame, text: str) -> DataFrame:
    found = extract_links(pages.withColumnRenamed("title", "page"), "page", text)
    return resolve_titles(found, "page", _names(c).where("name IS NOT NULL"))


def extract(c: Catalog, templates: list[str]) -> None:
    """``links`` (src, dst, labels), ``redirects`` (src, dst) and ``dabs`` (title, template)."""
    pages = c.read("pages").where((F.length(F.substring_index("title", ":", -1)) <= LONGEST_TITLE) & F.col("text").isNotNull())
    bare = c.write("stripped", pages.select("title", F.col("text").alias("raw"), strip_wiki_column(F.col("text")).alias("text")), "title")
    red = bare.where(is_redirect(F.col("text"))).select("title", F.concat(F.lit("[["), redirect_target(F.col("text")), F.lit("]]")).alias("text"))
    c.write("redirects", _own_links(c, red, "text").where(F.length("short_title") <= LONGEST_TITLE).select(F.col("page").alias("src"), "dst").distinct(), "src")
    rest = bare.where(~is_redirect(F.col("text")))
    main = split_title(rest, "title", _names(c)).where("namespace_id = 0")
    c.write("dabs", main.select("title", dab_template(F.col("raw"), templates).alias("template")).where("template IS NOT NULL"), "title")
    found = admitted_links(_own_links(c, rest.select("title", "text"), "text"))
    shown = found.select(F.col("page").alias("src"), "dst", F.array("display").alias("labels"))
    c.write("links", L.label_sets(shown), "src", "dst")


def extract_plain_text(c: Catalog) -> None:
    """``plain_text`` (title, text) and ``plain_text_links`` (title, offset, dst, display, hidden): pages of the main
    namespace that are no redirects, links replaced by what they show."""
    pages = split_title(c.read("pages").where("text IS NOT NULL"), "title", _names(c)).where("namespace_id = 0").where(~is_redirect(F.col("text")))
    found = cut(links_to_text(pages.select("title", strip_wiki_column(F.col("text")).alias("text")), "title", "text", _names(c).where("name IS NOT NULL")))
    c.write("plain_text", found.select(F.col("page").alias("title"), "text"), "title")
    c.write("plain_text_links", found.select(F.col("page").alias("title"), F.explode("links").alias("_l")).select("title", "_l.*"), "title", "offset")


def fix_links(c: Catalog) -> None:
    c.write("fixed_links", L.regroup(L.resolve_redirects(c.read("links"), c.read("redirects"))), "src", "dst")


def simplify_links(c: Catalog) -> None:
    c.write("out_links", L.adjacency(c.read("fixed_links"), "src", "dst"), "node", "part")
    c.write("in_links", L.adjacency(c.read("fixed_links"), "dst", "src"), "node", "part")


def link_rows(c: Catalog) -> DataFrame:
    """``doc``, ``pos``, ``is_amb``, ``target``, ``text``: a row per label of the fixed links."""
    rows = L.split_ambiguous(c.read("fixed_links"), c.read("dabs")).select("src", "dst", "is_amb", F.explode("labels").alias("_l")).select("src", "dst", "is_amb", normal_label(F.col("_l")).alias("text")).where("text IS NOT NULL")
    return rank_within(rows, ["src"], ["dst", "text"], "pos").select(F.col("src").alias("doc"), "pos", "is_amb", F.col("dst").alias("target"), "text")


def compress_links(c: Catalog) -> None:
    """``articles`` and ``texts``, the dictionaries, and ``compressed_links`` in their ids."""
    fixed, dabs = c.read("fixed_links"), c.read("dabs")
    names, order = dictionary.link_names(fixed, dabs)
    articles = c.write("articles", dictionary.first_seen_dictionary(names, "name", order), "name")
    rows = c.write("link_rows", link_rows(c), "doc", "pos")
    texts = c.write("texts", dictionary.first_seen_dictionary(rows, "text", F.struct("doc", "pos")), "name")
    e = dictionary.encode(dictionary.encode(rows, "target", articles, "target_id"), "text", texts, "text_id")
    c.write("compressed_links", e.select("doc", "pos", "is_amb", "target_id", "text_id"), "doc", "pos")


def generate_dab_lists(c: Catalog) -> None:
    """``dab_lists`` (dab, candidate): links in the list lines of disambiguation pages, redirects resolved."""
    dabs = c.read("dabs").select("title").distinct()
    lines = c.read("stripped").join(dabs, "title", "left_semi").select("title", F.array_join(list_lines(F.col("text")), "\n").alias("text"))
    found = admitted_links(_own_links(c, lines, "text")).select(F.col("page").alias("src"), "dst")
    fixed = L.resolve_redirects(found, c.read("redirects"))
    c.write("dab_lists", fixed.select(F.col("src").alias("dab"), F.col("dst").alias("candidate")).distinct(), "dab", "candidate")


def index_link_text(c: Catalog) -> None:
    index = c.write("label_index", L.label_index(L.exploded_labels(c.read("fixed_links"), "dst")), "text", "dst")
    c.write("label_targets", L.ordered_targets(index), "text", "pos")
    e = dictionary.encode(dictionary.encode(index, "text", c.read("texts"), "text_id"), "dst", c.read("articles"), "article_id")
    c.write("compressed_label_index", e.select("text_id", "article_id", "n"), "text_id")


def count(c: Catalog, tokenizer: str = "simple") -> None:
    """Link, word and candidate counts."""
    c.write("in_link_counts", L.in_link_counts(c.read("fixed_links")), "dst", "label")
    docs = c.read("plain_text")
    bags = c.write("bags", counting.bag_of_words(docs, "title", "text", tokenizer), "doc", "term")
    c.write("word_counts", counting.word_counts(bags), "term")
    c.write("word_totals", counting.word_totals(docs, "text", tokenizer), "documents")
    c.write("dab_list_sizes", L.histogram(c.read("dab_lists").groupBy("dab").agg(F.count("*").alias("_n")), F.col("_n")), "n")
    titles = c.read("dabs").select(F.col("title").alias("dst")).distinct()
    c.write("dab_link_counts", L.histogram(L.degrees(c.read("fixed_links").join(titles, "dst", "left_semi"), "dst", "src"), F.col("degree")), "n")


def decompress_links(c: Catalog) -> None:
    """``decompressed_links``: ``compressed_links`` with the names of both dictionaries."""
    named = dictionary.decode(dictionary.decode(c.read("compressed_links"), "target_id", c.read("articles"), "target"), "text_id", c.read("texts"), "text")
    c.write("decompressed_links", named.select("doc", "pos", "is_amb", "target", "text"), "doc", "pos")


def sample(c: Catalog, params: topics.Params, iterations: int, seed: int = 0, by: str = "target", keep_rate: int = 10, limit: int | None = None, resume: int | None = None) -> topics.Params:
    """``states`` and ``sampler_params`` of every ``keep_rate``-th iteration, ``state``, ``samples``, ``sample_average`` and
    ``topics`` of the topic model; ``by`` is 'target' for candidates by disambiguation page, 'text' by label of an ambiguous
    link. ``limit`` takes only the first documents in byte order; ``resume`` goes on from that stored iteration."""
    rows = c.read("link_rows")
    if by == "target":
        cands = c.read("dab_lists").select(F.col("dab").alias("key"), F.col("candidate").alias("cand"))
    else:
        used = rows.where("is_amb").select("text").distinct()
        cands = c.read("label_index").join(used, "text", "left_semi").select(F.col("text").alias("key"), F.col("dst").alias("cand"))
    if limit is not None:
        rows = rows.join(rows.select("doc").distinct().orderBy("doc").limit(limit), "doc", "left_semi")
    state = None
    if resume is not None:
        state = c.read("states").where(F.col("iteration") == resume).drop("iteration")
        stored = c.read("sampler_params").where(F.col("iteration") == resume).first()
        params = topics.Params(len(stored["alpha"]), stored["alpha"], stored["beta"], stored["gamma"])
    else:
        for name in ("states", "sampler_params"):
            if _exists(c, name):
                raise ValueError(f"{name} is there already; resume from one of its iterations or remove it")

    def keep(i: int, s: DataFrame, p: topics.Params) -> None:
        s.write.mode("overwrite").parquet(f"{c.root}/states/iteration={i}")
        row = c.spark.createDataFrame([(p.alpha, p.beta, p.gamma)], "alpha array<double>, beta double, gamma double")
        row.write.mode("overwrite").parquet(f"{c.root}/sampler_params/iteration={i}")

    state, _, params = topics.train(rows, cands, params, iterations, seed, keep_rate, by=by, state=state, after=resume or 0, keep=keep)
    c.write("state", state, "doc", "pos")
    c.write("samples", c.read("states").where("is_amb"), "iteration", "doc", "pos")
    average(c)
    c.write("topics", topics.top_articles(topics.topic_articles(state)), "topic", "rank")
    return params


def average(c: Catalog, start: int = 0, end: int | None = None) -> None:
    """``sample_average`` over the stored iterations from ``start`` to ``end``; the folders of others aren't read."""
    c.write("sample_average", topics.average_samples(c.read("states"), start, end), "doc", "dab")


def posterior(c: Catalog) -> None:
    """``sampler_results``: the probabilities of all candidates in the last state, by the last parameters."""
    last = c.read("sampler_params").orderBy(F.desc("iteration")).first()
    cands = c.read("dab_lists").select(F.col("dab").alias("key"), F.col("candidate").alias("cand"))
    params = topics.Params(len(last["alpha"]), last["alpha"], last["beta"], last["gamma"])
    c.write("sampler_results", topics.posterior(c.read("state"), cands, params), "doc", "pos")


def random_walk(c: Catalog, alpha: float = 0.95, tol: float = 0.001) -> None:
    e = c.read("fixed_links").select("src", "dst")
    c.write("walk_weights", exact_walks(e, e.select(F.col("src").alias("start")).distinct(), alpha, tol), "start", "node")


def run_lda(c: Catalog, k: int = 100, iterations: int = 20) -> None:
    c.write("topic_vectors", topic_vectors(c.read("bags"), k, iterations), "title")


def generate_evaluation(c: Catalog, newer: Catalog) -> None:
    """``cases`` and ``classes`` from links replaced between two snapshots; the classes are the newer one's. A case
    is a page, an ambiguous page it linked to and a label of that link; links without one have a case with a null label."""
    lists = newer.read("dab_lists")
    found = evaluation.replaced_links(c.read("fixed_links"), newer.read("fixed_links"), lists)
    labels = L.exploded_labels(c.read("fixed_links"), "src", "dst").withColumnRenamed("dst", "dab").distinct()
    found = found.join(labels, ["src", "dab"], "left").withColumn("class_id", F.col("dab"))
    c.write("cases", rank_within(found, [], ["dab", "src", "text"], "case_id"), "case_id")
    ranked = rank_within(lists, ["dab"], ["candidate"]).select(F.col("dab").alias("class_id"), (F.col("rank") - 1).cast("int").alias("class_idx"), F.col("candidate").alias("member"))
    c.write("classes", ranked, "class_id", "class_idx")


def generate_link_text_evaluation(c: Catalog, newer: Catalog) -> None:
    """``cases`` and ``classes`` of ambiguous labels instead of pages; the classes of a label are its targets in the newer index."""
    sets = lambda x: x.read("fixed_links").select("src", "dst", F.array_distinct(F.filter(F.transform("labels", lambda x: normal_label(x)), lambda t: t.isNotNull())).alias("labels"))
    index = newer.read("label_index")
    found = evaluation.replaced_labels(sets(c), sets(newer), index).withColumn("class_id", F.col("text"))
    c.write("cases", rank_within(found, [], ["dab", "src", "text"], "case_id"), "case_id")
    ranked = rank_within(index.join(found.select("text").distinct(), "text", "left_semi").select("text", "dst"), ["text"], ["dst"])
    c.write("classes", ranked.select(F.col("text").alias("class_id"), (F.col("rank") - 1).cast("int").alias("class_idx"), F.col("dst").alias("member")), "class_id", "class_idx")


def _context(c: Catalog, options: dict) -> scorers.Context:
    optional = {n: c.read(r) for n, r in (("vectors", "topic_vectors"), ("samples", "sample_average")) if _exists(c, r)}
    return scorers.Context(links=L.exploded_labels(c.read("fixed_links"), "src", "dst"), graph=c.read("fixed_links"), docs=c.read("plain_text"), options=options, **optional)


def evaluate(c: Catalog, scorer: str, top: int = 1, skip: int = 0, roc: str | None = None, **options) -> DataFrame:
    """One row with the accuracy of a scorer; ``roc_<scorer>`` and ``precision_<scorer>`` are written, and a tab-separated
    file of correctness and score below ``roc``, which must not be there."""
    cases, classes = evaluation.skip_cases(c.read("cases"), skip), c.read("classes")
    hits = evaluation.top_k_hits(evaluation.rank_classes(scorers.SCORERS[scorer](_context(c, options), cases, classes)), classes, cases, top)
    hits = c.write(f"roc_{scorer}", hits, "case_id")
    c.write(f"precision_{scorer}", evaluation.cumulative_precision(hits), "n")
    if roc is not None:
        dump.write_roc(hits, roc)
    return evaluation.accuracy(hits)


def write_scores(c: Catalog, names: list[str], path: str, **options) -> None:
    """Adds ``dab``, ``src``, ``class_idx``, ``valid`` and a column per scorer, a row per class of each case, to JSON lines."""
    cases, classes, ctx = c.read("cases"), c.read("classes"), _context(c, options)
    answer = cases.select("case_id", "class_id", "dab", "src", F.array_except("new_links", "old_links").alias("_a"))
    rows = answer.join(classes.groupBy("class_id", "class_idx").agg(F.collect_set("member").alias("_m")), "class_id")
    for n in names:
        rows = rows.join(scorers.SCORERS[n](ctx, cases, classes).withColumnRenamed("score", n), ["case_id", "class_idx"], "left")
    dump.write_scores(rows.select("dab", "src", "class_idx", F.arrays_overlap("_m", "_a").alias("valid"), *names), path)


def write_svm_rank(c: Catalog, names: list[str], path: str, **options) -> None:
    cases, classes, ctx = c.read("cases"), c.read("classes"), _context(c, options)
    dump.write_lines(evaluation.svm_rank_lines(cases, classes, [scorers.SCORERS[n](ctx, cases, classes) for n in names]), "line", path)


def generate_svm_training(c: Catalog) -> None:
    """``svm_training`` (dab, src, picked, feature): neighbours of a neighbour as features."""
    c.write("svm_training", L.neighbour_features(c.read("fixed_links"), c.read("dabs")), "dab", "src")


def print_plain_text(c: Catalog, path: str) -> None:
    """Bags of words as text lines, and ``bag_terms``, their dictionary."""
    bags = c.read("bags")
    words = c.write("bag_terms", dictionary.sorted_dictionary(bags, "term"), "name")
    dump.write_lines(counting.bag_lines(bags, words), "line", path)


def save_lda(c: Catalog, vectors: str, skip_first: bool) -> None:
    """``topic_vectors`` from lines of numbers in the order of the titles of ``plain_text``; ``skip_first`` drops each line's first token."""
    labels = rank_within(c.read("plain_text").select("title"), [], ["title"], "pos").withColumn("pos", F.col("pos") - 1)
    c.write("topic_vectors", dump.read_vectors(c.spark, labels, vectors, skip_first), "title")


def class_counts(c: Catalog, dab: str | None = None, text: str | None = None) -> DataFrame:
    """``member``, ``n``: the in-links of the candidates of one ambiguous page, or the targets of one label, most first."""
    if dab is not None:
        cands = dump.lookup(c.read("dab_lists"), "dab", dab)
        found = L.candidate_counts(cands, c.read("fixed_links")).select(F.col("candidate").alias("member"), "n")
    else:
        found = dump.lookup(c.read("label_index"), "text", text).select(F.col("dst").alias("member"), "n")
    return found.orderBy(F.desc("n"), "member")


def show(c: Catalog, name: str, key: str, values: list[str], prefix: bool = False) -> DataFrame:
    """The rows of a relation with these keys, or with keys that begin so."""
    if not prefix:
        return dump.lookup(c.read(name), key, *values)
    found = [dump.lookup_prefix(c.read(name), key, v) for v in values]
    return reduce(DataFrame.unionByName, found).distinct()


def list_languages(c: Catalog) -> DataFrame:
    return c.read("namespaces").select("lang").distinct().orderBy("lang")


def _exists(c: Catalog, name: str) -> bool:
    path = c.spark._jvm.org.apache.hadoop.fs.Path(f"{c.root}/{name}")
    return path.getFileSystem(c.spark._jsc.hadoopConfiguration()).exists(path)
