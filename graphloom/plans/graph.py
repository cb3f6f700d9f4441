"""Queries of the link graph, its labels, texts, scorers and topic model."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import vectors
from graphloom.functions.keys import CANONICAL_SQL, PAGE_KEY_SQL, canonical_target, page_keys
from graphloom.functions.text import LATIN, normal_label
from graphloom.functions.wikitext import extract_links, is_redirect, links_to_text, list_lines, redirect_target, split_sections, split_title
from graphloom.operators import counting, dictionary, evaluation, links as L, scorers, similarity, topics
from graphloom.operators.dirichlet import symmetric_step
from graphloom.operators.ranking import rank_within
from graphloom.operators.walk import exact_walks, level_walks
from graphloom.registry import Registry
from graphloom.session import cut
from graphloom.sources.tables import table

registry = Registry()
query = registry.query

SPLIT = "2013-01-01"
TOPICS = 8
LABEL_TOKENS = r"[\p{L}\p{N}]+(?:[''.][\p{L}\p{N}]+)*"
NORM_SQL = f"array_to_string(regexp_extract_all(lower(label), '{LABEL_TOKENS}'), ' ')"

LINKS_SQL = f"links AS (SELECT DISTINCT link_id, src, {CANONICAL_SQL} AS dst, labels, seen_at FROM links_raw)"
TEXTS_SQL = f"""{LINKS_SQL},
exploded AS (SELECT link_id, src, dst, unnest(labels) AS label, generate_subscripts(labels, 1) AS k, seen_at FROM links),
labelled AS (SELECT link_id, src, dst, k, seen_at, {NORM_SQL} AS text FROM exploded WHERE {NORM_SQL} <> '')"""
INDEX_SQL = f"{TEXTS_SQL}, idx AS (SELECT text, dst, count(*) AS n FROM labelled GROUP BY text, dst)"


def links(spark: SparkSession, d: str) -> DataFrame:
    """``link_id``, ``src``, ``dst``, ``labels``, ``seen_at``: each link once, its target in canonical spelling."""
    raw = table(spark, d, "links_raw").dropDuplicates(["link_id"])
    return raw.select("link_id", "src", canonical_target(F.col("dst")).alias("dst"), "labels", "seen_at")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """``src``, ``dst``, each pair once; the ids of repeated links don't matter here."""
    return table(spark, d, "links_raw").select("src", canonical_target(F.col("dst")).alias("dst")).distinct()


#: Of so many repeated ids at most are sent to the executors.
MOST_REPEATED = 1_000_000


def once(raw: DataFrame, key: str) -> DataFrame:
    """One row of each ``key``: ids are counted first, and only rows of repeated ones are shuffled whole."""
    repeated = cut(raw.groupBy(F.col(key).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id"))
    if repeated.count() > MOST_REPEATED:
        return raw.dropDuplicates([key])
    few, same = F.broadcast(repeated.where("_id IS NOT NULL")), F.col(key) == F.col("_id")
    again = raw.join(few, same, "left_semi").unionByName(raw.where(F.col(key).isNull())).dropDuplicates([key])
    return raw.where(F.col(key).isNotNull()).join(few, same, "left_anti").unionByName(again)


def labelled(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """A row per label that has a token, with ``k``, its place from 1."""
    of = of if of is not None else links(spark, d)
    keep = [c for c in ("link_id", "src", "dst", "seen_at") if c in of.columns]
    e = of.select(*keep, F.posexplode("labels").alias("_k", "_label"))
    return e.select(*keep, (F.col("_k") + 1).alias("k"), normal_label(F.col("_label")).alias("text")).where("text IS NOT NULL")


def index(spark: SparkSession, d: str) -> DataFrame:
    return L.label_index(labelled(spark, d))


# Labels


@query("label_index", f"WITH {INDEX_SQL} SELECT text, dst, n FROM idx")
def label_index(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d)


@query("label_share_top1", f"""
WITH {INDEX_SQL}, s AS (SELECT text, dst, n, n / sum(n) OVER (PARTITION BY text) AS share, row_number() OVER (PARTITION BY text ORDER BY n DESC, dst) AS r FROM idx)
SELECT text, dst, n, round(share, 9) AS share FROM s WHERE r = 1
""")  # fmt: skip
def label_share_top1(spark: SparkSession, d: str) -> DataFrame:
    best = L.best_targets(L.label_shares(index(spark, d)))
    return best.select("text", "dst", "n", F.round("share", 9).alias("share"))


@query("in_link_label_counts", f"""
WITH {LINKS_SQL}, l AS (SELECT dst, coalesce(array_to_string(labels, chr(9)), '') AS label FROM links)
SELECT dst, label, false AS is_total, count(*) AS n FROM l GROUP BY dst, label
UNION ALL SELECT dst, '', true, count(*) FROM l GROUP BY dst
""")  # fmt: skip
def in_link_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.in_link_counts(links(spark, d))


@query("in_link_single_label_counts", f"""
WITH {LINKS_SQL}
SELECT dst, label, false AS is_total, count(*) AS n FROM (SELECT dst, unnest(labels) AS label FROM links) GROUP BY dst, label
UNION ALL SELECT dst, '', true, count(*) FROM links GROUP BY dst
""")  # fmt: skip
def in_link_single_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.in_link_counts(links(spark, d), explode=True)


@query("link_probability_groups", f"WITH {INDEX_SQL} SELECT text, row_number() OVER (PARTITION BY text ORDER BY dst) AS pos, dst, n FROM idx")
def link_probability_groups(spark: SparkSession, d: str) -> DataFrame:
    return L.ordered_targets(index(spark, d))


@query("normalized_labels", f"WITH {LINKS_SQL} SELECT DISTINCT label AS raw, {NORM_SQL} AS norm FROM (SELECT unnest(labels) AS label FROM links) WHERE {NORM_SQL} <> ''")
def normalized_labels(spark: SparkSession, d: str) -> DataFrame:
    raw = links(spark, d).select(F.explode("labels").alias("raw")).distinct()
    return raw.withColumn("norm", normal_label(F.col("raw"))).where("norm IS NOT NULL")


@query("label_sets", f"WITH {LINKS_SQL} SELECT src, dst, list_sort(list(DISTINCT label)) AS labels FROM (SELECT src, dst, unnest(labels) AS label FROM links) GROUP BY src, dst")
def label_sets(spark: SparkSession, d: str) -> DataFrame:
    return L.label_sets(links(spark, d))


@query("candidate_size_histogram", f"WITH {INDEX_SQL}, s AS (SELECT text, count(*) AS n FROM idx GROUP BY text) SELECT n, count(*) AS freq FROM s GROUP BY n")
def candidate_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    sizes = index(spark, d).groupBy("text").agg(F.count("*").alias("_n"))
    return L.histogram(sizes, F.col("_n"))


@query("class_counts_for_label", f"WITH {INDEX_SQL} SELECT dst, n FROM idx WHERE text = 'main article'")
def class_counts_for_label(spark: SparkSession, d: str) -> DataFrame:
    """The targets of one label; the filter is applied before the count."""
    return L.label_index(labelled(spark, d).where(F.col("text") == "main article")).select("dst", "n")


# Graph

RESOLVED_SQL = f"""{LINKS_SQL}, red AS (SELECT src AS rsrc, min(dst) AS rdst FROM redirects GROUP BY src),
resolved AS (SELECT link_id, src, coalesce(rdst, dst) AS dst, labels, seen_at, rdst IS NOT NULL AS fixed FROM links LEFT JOIN red ON dst = rsrc)"""


def resolved(spark: SparkSession, d: str) -> DataFrame:
    return L.resolve_redirects(links(spark, d), table(spark, d, "redirects"))


@query("redirect_resolve", f"WITH {RESOLVED_SQL} SELECT src, dst, list_sort(flatten(list(coalesce(labels, [])))) AS labels FROM resolved GROUP BY src, dst")
def redirect_resolve(spark: SparkSession, d: str) -> DataFrame:
    return L.regroup(resolved(spark, d))


@query("redirect_hits", f"WITH {RESOLVED_SQL} SELECT count(*) AS links, count(*) FILTER (fixed) AS hits FROM resolved")
def redirect_hits(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).agg(F.count("*").alias("links"), F.count_if("fixed").alias("hits"))


@query("redirect_two_hops", f"""
WITH {RESOLVED_SQL} SELECT link_id, coalesce(rdst, dst) AS dst FROM resolved LEFT JOIN red ON dst = rsrc
""")  # fmt: skip
def redirect_two_hops(spark: SparkSession, d: str) -> DataFrame:
    return L.resolve_redirects(links(spark, d), table(spark, d, "redirects"), hops=2).select("link_id", "dst")


def _adjacency_sql(node: str, other: str) -> str:
    return f"""
WITH {LINKS_SQL}, e AS (SELECT DISTINCT {node} AS node, {other} AS o FROM links), r AS (SELECT node, o, (row_number() OVER (PARTITION BY node ORDER BY o) - 1) // 1000 AS part FROM e)
SELECT node, part, list(o ORDER BY o) AS neighbours FROM r GROUP BY node, part
"""  # fmt: skip


@query("adjacency_out", _adjacency_sql("src", "dst"))
def adjacency_out(spark: SparkSession, d: str) -> DataFrame:
    return L.adjacency(links(spark, d), "src", "dst")


@query("adjacency_in", _adjacency_sql("dst", "src"))
def adjacency_in(spark: SparkSession, d: str) -> DataFrame:
    return L.adjacency(links(spark, d), "dst", "src")


@query("indegree_histogram_of_ambiguous", f"""
WITH {LINKS_SQL}, g AS (SELECT dst, count(DISTINCT src) AS n FROM links WHERE dst IN (SELECT title FROM dabs) GROUP BY dst) SELECT n, count(*) AS freq FROM g GROUP BY n
""")  # fmt: skip
def indegree_histogram_of_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "dabs").select(F.col("title").alias("dst")).distinct()
    ambiguous = links(spark, d).join(titles, "dst", "left_semi")
    return L.histogram(L.degrees(ambiguous, "dst", "src"), F.col("degree"))


@query("ambiguous_split", f"""
WITH {LINKS_SQL} SELECT src, count(*) FILTER (dst NOT IN (SELECT title FROM dabs)) AS n_regular, count(*) FILTER (dst IN (SELECT title FROM dabs)) AS n_ambiguous FROM links GROUP BY src
""")  # fmt: skip
def ambiguous_split(spark: SparkSession, d: str) -> DataFrame:
    s = L.split_ambiguous(links(spark, d), table(spark, d, "dabs"))
    return s.groupBy("src").agg(F.count_if(~F.col("is_amb")).alias("n_regular"), F.count_if("is_amb").alias("n_ambiguous"))


CANDIDATES_SQL = f"{LINKS_SQL}, cands AS (SELECT DISTINCT src AS dab, dst AS candidate FROM links WHERE src IN (SELECT title FROM dabs))"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return L.candidates(links(spark, d), table(spark, d, "dabs"))


@query("dab_candidates", f"WITH {CANDIDATES_SQL} SELECT dab, list(candidate ORDER BY candidate) AS candidates FROM cands GROUP BY dab")
def dab_candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).groupBy("dab").agg(F.array_sort(F.collect_list("candidate")).alias("candidates"))


@query("dab_size_histogram", f"WITH {CANDIDATES_SQL}, s AS (SELECT count(*) AS n FROM cands GROUP BY dab) SELECT n, count(*) AS freq FROM s GROUP BY n")
def dab_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return L.histogram(candidates(spark, d).groupBy("dab").agg(F.count("*").alias("_n")), F.col("_n"))


@query("class_counts_for_dab", f"""
WITH {CANDIDATES_SQL}, n AS (SELECT dst, count(*) AS n FROM links GROUP BY dst) SELECT dab, candidate, coalesce(n, 0) AS n FROM cands LEFT JOIN n ON candidate = dst
""")  # fmt: skip
def class_counts_for_dab(spark: SparkSession, d: str) -> DataFrame:
    return L.candidate_counts(candidates(spark, d), links(spark, d))


# Dictionaries


@query("dictionary_first_seen", f"""
WITH {LINKS_SQL}, o AS (
  SELECT title AS name, 0 AS stage, title AS a, '' AS b, 0 AS c FROM dabs
  UNION ALL SELECT src, 1, src, dst, 0 FROM links UNION ALL SELECT dst, 1, src, dst, 1 FROM links
), f AS (SELECT name, min((stage, a, b, c)) AS k FROM o WHERE name IS NOT NULL GROUP BY name)
SELECT name, row_number() OVER (ORDER BY k) AS id FROM f
""")  # fmt: skip
def dictionary_first_seen(spark: SparkSession, d: str) -> DataFrame:
    names, order = dictionary.link_names(links(spark, d), table(spark, d, "dabs"))
    return dictionary.first_seen_dictionary(names, "name", order)


@query("dictionary_sorted", f"WITH {TEXTS_SQL} SELECT text AS name, row_number() OVER (ORDER BY text) AS id FROM (SELECT DISTINCT text FROM labelled)")
def dictionary_sorted(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.sorted_dictionary(labelled(spark, d), "text")


@query("encoded_label_index", f"""
WITH {INDEX_SQL}, td AS (SELECT text, row_number() OVER (ORDER BY text) AS text_id FROM (SELECT DISTINCT text FROM idx)),
ad AS (SELECT dst, row_number() OVER (ORDER BY dst) AS article_id FROM (SELECT DISTINCT dst FROM idx))
SELECT text_id, article_id, n FROM idx JOIN td USING (text) JOIN ad USING (dst)
""")  # fmt: skip
def encoded_label_index(spark: SparkSession, d: str) -> DataFrame:
    i = cut(index(spark, d))
    e = dictionary.encode(i, "text", dictionary.sorted_dictionary(i, "text"), "text_id")
    return dictionary.encode(e, "dst", dictionary.sorted_dictionary(i, "dst"), "article_id").select("text_id", "article_id", "n")


@query("title_parse", f"""
WITH {LINKS_SQL}, t AS (SELECT DISTINCT dst AS title FROM links), h AS (SELECT title, split_part(title, ':', 1) AS head, substr(title, instr(title, ':') + 1) AS rest FROM t),
k AS (SELECT h.*, l.lang FROM h LEFT JOIN (SELECT DISTINCT lang FROM namespaces) l ON head = l.lang),
n AS (SELECT k.*, s.ns_id FROM k LEFT JOIN namespaces s ON k.lang = s.lang AND instr(rest, ':') > 0 AND lower(split_part(rest, ':', 1)) = lower(s.name) AND s.name <> '')
SELECT title, lang AS language, coalesce(ns_id, 0) AS namespace_id,
  CASE WHEN ns_id IS NOT NULL THEN substr(rest, instr(rest, ':') + 1) WHEN lang IS NOT NULL THEN rest ELSE title END AS short_title FROM n
""")  # fmt: skip
def title_parse(spark: SparkSession, d: str) -> DataFrame:
    titles = links(spark, d).select(F.col("dst").alias("title")).distinct()
    return split_title(titles, "title", table(spark, d, "namespaces"))


# Texts

DOCS_SQL = f"""keyed AS ({PAGE_KEY_SQL}),
latest AS (SELECT k.key AS title, r.text, row_number() OVER (PARTITION BY k.key ORDER BY r.saved_at DESC, r.id DESC) AS rn FROM (SELECT DISTINCT id, page_id, text, saved_at FROM revisions) r JOIN (SELECT DISTINCT id, key FROM keyed) k ON r.page_id = k.id WHERE r.text IS NOT NULL AND k.key IS NOT NULL),
docs AS (SELECT title, text FROM latest WHERE rn = 1)"""
BAGS_SQL = f"""{DOCS_SQL}, words AS (SELECT title AS doc, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM docs),
bags AS (SELECT doc, term, count(*) AS n FROM words GROUP BY doc, term), wc AS (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM bags GROUP BY term)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    """``title``, ``text``: the latest text of each page key."""
    keyed = page_keys(table(spark, d, "pages"), table(spark, d, "namespaces"), "id").distinct()
    r = table(spark, d, "revisions").where("text IS NOT NULL").select("page_id", "text", F.struct("saved_at", "id").alias("_at"))
    return r.join(keyed, r["page_id"] == keyed["id"]).groupBy(F.col("key").alias("title")).agg(F.max_by("text", "_at").alias("text"))


def bags(spark: SparkSession, d: str) -> DataFrame:
    return counting.bag_of_words(docs(spark, d), "title", "text")


@query("word_counts", f"WITH {BAGS_SQL} SELECT term, df, cf FROM wc")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return counting.word_counts(bags(spark, d))


@query("word_totals", f"WITH {DOCS_SQL} SELECT count(*) AS documents, CAST(sum(len(regexp_extract_all(lower(text), '\\p{{L}}+'))) AS BIGINT) AS words FROM docs")
def word_totals(spark: SparkSession, d: str) -> DataFrame:
    return counting.word_totals(docs(spark, d), "text")


@query("bag_of_words", f"WITH {BAGS_SQL} SELECT doc, term, n FROM bags")
def bag_of_words(spark: SparkSession, d: str) -> DataFrame:
    return bags(spark, d)


@query("bag_lines", f"""
WITH {BAGS_SQL}, dict AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM wc)
SELECT doc, '| ' || string_agg(id || ':' || n, ' ' ORDER BY id) AS line FROM bags JOIN dict USING (term) GROUP BY doc
""")  # fmt: skip
def bag_lines(spark: SparkSession, d: str) -> DataFrame:
    b = cut(bags(spark, d))
    return counting.bag_lines(b, dictionary.sorted_dictionary(b, "term"))


TFIDF_SQL = f"""{BAGS_SQL}, total AS (SELECT count(*) AS n_docs FROM docs),
raw AS (SELECT doc, term, (1 + ln(n)) * ln(n_docs // df) AS w, (1 + ln(n)) * ln(n_docs / df) AS w_real FROM bags JOIN wc USING (term), total),
norms AS (SELECT doc, sqrt(sum(w * w)) AS norm, sqrt(sum(w_real * w_real)) AS norm_real FROM raw GROUP BY doc),
weights AS (SELECT doc, term, CASE WHEN norm > 0 THEN w / norm ELSE w END AS w, CASE WHEN norm_real > 0 THEN w_real / norm_real ELSE w_real END AS w_real FROM raw JOIN norms USING (doc))"""


@query("tfidf_weights", f"WITH {TFIDF_SQL} SELECT doc, term, round(w, 6) AS w, round(w_real, 6) AS w_real FROM weights")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    b = cut(bags(spark, d))
    counts, n = counting.word_counts(b), docs(spark, d).count()
    a = similarity.tfidf(b, counts, n)
    c = similarity.tfidf(b, counts, n, idf="real").withColumnRenamed("w", "w_real")
    return a.join(c, ["doc", "term"]).select("doc", "term", F.round("w", 6).alias("w"), F.round("w_real", 6).alias("w_real"))


CASES_SQL = f"""{TEXTS_SQL}, cands AS (SELECT DISTINCT src AS dab, dst AS candidate FROM links WHERE src IN (SELECT title FROM dabs)),
classes AS (SELECT dab AS class_id, row_number() OVER (PARTITION BY dab ORDER BY candidate) - 1 AS class_idx, candidate AS member FROM cands),
edges AS (SELECT DISTINCT src, dst FROM links),
amb AS (SELECT dst AS dab, src, min(text) AS text FROM labelled WHERE dst IN (SELECT dab FROM cands) GROUP BY dst, src),
cases AS (SELECT row_number() OVER (ORDER BY dab, src) AS case_id, dab AS class_id, dab, src, text FROM amb),
answers AS (SELECT DISTINCT c.case_id, m.member FROM cases c JOIN classes m USING (class_id) JOIN edges e ON e.src = c.src AND e.dst = m.member)"""


class Cases:
    """Cases, one per page and ambiguous page it links to, and ``classes``, one per candidate.

    The links are written once; what else a scorer needs is made when it is asked for.
    """

    def __init__(self, spark: SparkSession, d: str, **options) -> None:
        self.spark, self.d, self.options = spark, d, options
        raw = once(table(spark, d, "links_raw").select("link_id", "src", "dst", "labels"), "link_id")
        self.links = cut(raw.select("src", canonical_target(F.col("dst")).alias("dst"), "labels"))

    @cached_property
    def context(self) -> scorers.Context:
        labels = labelled(self.spark, self.d, self.links).select("src", "dst", "text")
        return scorers.Context(links=labels, graph=self.links, docs=docs(self.spark, self.d), options=self.options)

    @cached_property
    def candidates(self) -> DataFrame:
        return cut(L.candidates(self.links, table(self.spark, self.d, "dabs")))

    @cached_property
    def classes(self) -> DataFrame:
        return cut(rank_within(self.candidates, ["dab"], ["candidate"]).select(F.col("dab").alias("class_id"), (F.col("rank") - 1).cast("int").alias("class_idx"), F.col("candidate").alias("member")))

    @cached_property
    def cases(self) -> DataFrame:
        ambiguous = self.links.join(self.candidates.select(F.col("dab").alias("dst")).distinct(), "dst", "left_semi")
        amb = labelled(self.spark, self.d, ambiguous).groupBy(F.col("dst").alias("dab"), "src").agg(F.min("text").alias("text"))
        return cut(rank_within(amb, [], ["dab", "src"], "case_id").select("case_id", F.col("dab").alias("class_id"), "dab", "src", "text"))

    @cached_property
    def answered(self) -> DataFrame:
        """The cases with their answer, ``new_links``: the candidates that the page links to as well; there are no ``old_links``."""
        edges = self.context.edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
        hit = (F.col("src") == F.col("_s")) & (F.col("member") == F.col("_d"))
        hits = self.cases.select("case_id", "class_id", "src").join(self.classes, "class_id").join(edges, hit).groupBy("case_id").agg(F.array_sort(F.collect_set("member")).alias("_new"))
        none = F.array().cast("array<string>")
        return cut(self.cases.join(hits, "case_id", "left").select("case_id", "class_id", "dab", "src", "text", none.alias("old_links"), F.coalesce("_new", none).alias("new_links")))

    def score(self, name: str | scorers.Scorer) -> DataFrame:
        f = scorers.SCORERS[name] if isinstance(name, str) else name
        return f(self.context, self.answered if name == "svm" else self.cases, self.classes)


def scored(spark: SparkSession, d: str, name: str | scorers.Scorer, **options) -> DataFrame:
    return Cases(spark, d, **options).score(name).select("case_id", "class_idx", F.round("score", 6).alias("score"))


BASELINE_SQL = """per AS (SELECT class_id, class_idx, count(DISTINCT lsrc) AS n FROM classes LEFT JOIN (SELECT src AS lsrc, dst AS ldst FROM edges) l ON member = ldst GROUP BY class_id, class_idx),
baseline AS (SELECT case_id, class_idx, n / greatest(sum(n) OVER (PARTITION BY case_id), 1) AS score FROM cases JOIN per USING (class_id))"""
LINK_TEXT_SQL = """hits AS (SELECT dst, text, count(*) AS n FROM labelled GROUP BY dst, text),
lt AS (SELECT case_id, class_idx, coalesce(n, 0) AS n FROM cases c JOIN classes k USING (class_id) LEFT JOIN hits h ON h.dst = k.member AND h.text = c.text),
link_text AS (SELECT case_id, class_idx, n / CASE WHEN sum(n) OVER (PARTITION BY case_id) = 0 THEN 1 ELSE sum(n) OVER (PARTITION BY case_id) END AS score FROM lt)"""


@query("baseline_share", f"WITH {CASES_SQL}, {BASELINE_SQL} SELECT case_id, class_idx, round(score, 6) AS score FROM baseline")
def baseline_share(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, "baseline")


@query("link_text_share", f"WITH {CASES_SQL}, {LINK_TEXT_SQL} SELECT case_id, class_idx, round(score, 6) AS score FROM link_text")
def link_text_share(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, "link_text")


@query("weighted_combination", f"""
WITH {CASES_SQL}, {BASELINE_SQL}, {LINK_TEXT_SQL}
SELECT case_id, class_idx, round(0.25 * b.score + 0.75 * t.score, 6) AS score FROM baseline b JOIN link_text t USING (case_id, class_idx)
""")  # fmt: skip
def weighted_combination(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, scorers.weighted({"baseline": 0.25, "link_text": 0.75}))


@query("tfidf_scores", f"""
WITH {CASES_SQL}, {TFIDF_SQL}, sims AS (
  SELECT p.src, p.member, sum(x.w * y.w) AS sim FROM (SELECT DISTINCT src, member FROM cases JOIN classes USING (class_id)) p
  JOIN weights x ON x.doc = p.src JOIN weights y ON y.doc = p.member AND y.term = x.term GROUP BY p.src, p.member)
SELECT case_id, class_idx, round(coalesce(sim, 0), 6) AS score FROM cases c JOIN classes k USING (class_id) LEFT JOIN sims s ON s.src = c.src AND s.member = k.member
""")  # fmt: skip
def tfidf_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, "tfidf")


@query("jaccard_scores", f"""
WITH {CASES_SQL}, {DOCS_SQL}, sets AS (SELECT title, list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+')) AS s FROM docs)
SELECT case_id, class_idx, round(coalesce(len(list_intersect(x.s, y.s)) / greatest(len(list_distinct(list_concat(x.s, y.s))), 1), 0), 6) AS score
FROM cases c JOIN classes k USING (class_id) LEFT JOIN sets x ON x.title = c.src LEFT JOIN sets y ON y.title = k.member
""")  # fmt: skip
def jaccard_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, "jaccard")


LATIN_SQL = f"[{LATIN}]+"


@query("latin_jaccard_scores", f"""
WITH {CASES_SQL}, {DOCS_SQL}, sets AS (SELECT title, list_distinct(regexp_extract_all(text, '{LATIN_SQL}')) AS s FROM docs)
SELECT case_id, class_idx, round(coalesce(len(list_intersect(x.s, y.s)) / greatest(len(list_distinct(list_concat(x.s, y.s))), 1), 0), 6) AS score
FROM cases c JOIN classes k USING (class_id) LEFT JOIN sets x ON x.title = c.src LEFT JOIN sets y ON y.title = k.member
""")  # fmt: skip
def latin_jaccard_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, "jaccard_latin")


@query("relatedness", f"""
WITH {CASES_SQL}, p AS (SELECT DISTINCT src AS a, member AS b FROM cases JOIN classes USING (class_id)),
n AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst), o AS (SELECT a, b, count(*) AS o FROM p JOIN edges x ON x.dst = a JOIN edges y ON y.dst = b AND y.src = x.src GROUP BY a, b)
SELECT a, b, round(CASE WHEN coalesce(o, 0) = 0 THEN 0 ELSE exp(-(ln(greatest(na.n, nb.n)) - ln(o)) / (ln(3900000) - ln(least(na.n, nb.n)))) END, 6) AS rel
FROM p LEFT JOIN n na ON na.dst = a LEFT JOIN n nb ON nb.dst = b LEFT JOIN o USING (a, b)
""")  # fmt: skip
def relatedness(spark: SparkSession, d: str) -> DataFrame:
    c = Cases(spark, d)
    pairs = scorers.members_of(c.cases, c.classes).select(F.col("src").alias("a"), F.col("member").alias("b"))
    o = similarity.neighbour_overlaps(pairs, c.context.edges)
    return o.select("a", "b", F.round(vectors.relatedness(F.col("size_a"), F.col("size_b"), F.col("overlap"), scorers.ARTICLES), 6).alias("rel"))


@query("relatedness_scores", f"""
WITH {CASES_SQL}, near AS (SELECT case_id, dst AS near FROM cases c JOIN edges e ON e.src = c.src WHERE dst <> dab UNION SELECT case_id, src FROM cases),
m AS (SELECT c.case_id, c.src, c.dab, k.class_idx, k.member, w.near FROM cases c JOIN classes k USING (class_id) JOIN near w USING (case_id)), p AS (SELECT DISTINCT near AS a, member AS b FROM m WHERE near <> member),
n AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst), o AS (SELECT a, b, count(*) AS o FROM p JOIN edges x ON x.dst = a JOIN edges y ON y.dst = b AND y.src = x.src GROUP BY a, b),
r AS (SELECT a, b, exp(-(ln(greatest(na.n, nb.n)) - ln(o)) / (ln(3900000) - ln(least(na.n, nb.n)))) AS r FROM o JOIN n na ON na.dst = a JOIN n nb ON nb.dst = b)
SELECT case_id, class_idx, round(CASE WHEN bool_or(member = dab) THEN -999 ELSE max(CASE WHEN member = src THEN 0 ELSE coalesce(r, 0) END) END, 6) AS score FROM m LEFT JOIN r ON near = a AND member = b GROUP BY case_id, class_idx
""")  # fmt: skip
def relatedness_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, "relatedness")


@query("out_link_scores", f"""
WITH {CASES_SQL}, b AS (SELECT src AS doc, dst AS term, count(*) AS n FROM links GROUP BY src, dst), f AS (SELECT term, count(*) AS df FROM b GROUP BY term), size AS (SELECT count(DISTINCT src) AS n_docs FROM links),
raw AS (SELECT doc, term, (1 + ln(n)) * ln(n_docs // df) AS w FROM b JOIN f USING (term), size), norms AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc),
weights AS (SELECT doc, term, CASE WHEN norm > 0 THEN w / norm ELSE w END AS w FROM raw JOIN norms USING (doc)),
sims AS (SELECT p.src, p.member, sum(x.w * y.w) AS sim FROM (SELECT DISTINCT src, member FROM cases JOIN classes USING (class_id)) p JOIN weights x ON x.doc = p.src JOIN weights y ON y.doc = p.member AND y.term = x.term GROUP BY p.src, p.member)
SELECT case_id, class_idx, round(coalesce(sim, 0), 6) AS score FROM cases c JOIN classes k USING (class_id) LEFT JOIN sims s ON s.src = c.src AND s.member = k.member
""")  # fmt: skip
def out_link_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, "out_links")


@query("in_link_sample_scores", f"""
WITH {CASES_SQL}, {TFIDF_SQL}, linked AS (SELECT DISTINCT class_id, class_idx, src AS page FROM classes JOIN edges ON dst = member),
near AS (
  SELECT class_id, class_idx, page FROM (SELECT *, row_number() OVER (PARTITION BY class_id, class_idx ORDER BY md5(page), page) AS r FROM linked) WHERE r <= 100
  UNION SELECT class_id, class_idx, member FROM classes
), m AS (SELECT case_id, class_idx, src, page FROM cases JOIN near USING (class_id)),
sims AS (SELECT p.src, p.page, sum(x.w * y.w) AS sim FROM (SELECT DISTINCT src, page FROM m) p JOIN weights x ON x.doc = p.src JOIN weights y ON y.doc = p.page AND y.term = x.term GROUP BY p.src, p.page)
SELECT case_id, class_idx, round(max(coalesce(sim, 0)), 6) AS score FROM m LEFT JOIN sims USING (src, page) GROUP BY case_id, class_idx
""")  # fmt: skip
def in_link_sample_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, "tfidf_in_links")


@query("svm_scores")
def svm_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, "svm")


# Vectors

VEC_SQL = """raw AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, abs(CAST(unnest(embedding) AS DOUBLE)) + 1e-6 AS x FROM embeddings),
v AS (SELECT vec_id, label, i, x / sum(x) OVER (PARTITION BY vec_id) AS x FROM raw), c AS (SELECT label AS class, i, avg(x) AS y FROM v GROUP BY label, i)"""
_TERMS = {"l1": "abs(x - y)", "l2": "(sqrt(x) - sqrt(y)) * (sqrt(x) - sqrt(y))", "kl": "x * ln(x / y)", "lk": "y * ln(y / x)", "irad": "x * ln(x / (x + y)) + y * ln(y / (x + y))"}


def _distributions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as distributions, and the mean one of each class; a class mean has one row per dimension before it is gathered."""
    v = table(spark, d, "embeddings").select("vec_id", "label", vectors.to_distribution(F.transform("embedding", lambda x: F.abs(x.cast("double")) + F.lit(1e-6))).alias("v"))
    means = v.select("label", F.posexplode("v").alias("i", "x")).groupBy(F.col("label").alias("class"), "i").agg(F.avg("x").alias("y"))
    return v, means.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("c"))


@query("divergences", f"""
WITH {VEC_SQL} SELECT vec_id, {', '.join(f'round(sum({e}), 6) AS {n}' for n, e in _TERMS.items())} FROM v JOIN c ON label = class AND v.i = c.i GROUP BY vec_id
""")  # fmt: skip
def divergences(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's divergences from the mean of its class."""
    v, c = _distributions(spark, d)
    j = v.join(c, v["label"] == c["class"])
    return j.select("vec_id", *[F.round(f(F.col("v"), F.col("c")), 6).alias(n) for n, f in vectors.DIVERGENCES.items()])


@query("lda_nearest_class", f"""
WITH {VEC_SQL}, s AS (SELECT vec_id, class, round(sum(x * ln(x / y)), 9) AS div FROM v JOIN c ON v.i = c.i GROUP BY vec_id, class)
SELECT vec_id, class, round(div, 6) AS div FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY div, class) AS r FROM s) WHERE r = 1
""")  # fmt: skip
def lda_nearest_class(spark: SparkSession, d: str) -> DataFrame:
    """The class with the nearest mean."""
    v, c = _distributions(spark, d)
    near = vectors.nearest(v, "vec_id", "v", c, "class", "c")
    return near.select("vec_id", "class", F.round("div", 6).alias("div"))


# Evaluation

SNAPSHOTS_SQL = f"{CASES_SQL}, o AS (SELECT DISTINCT src, dst FROM links WHERE seen_at < TIMESTAMP '{SPLIT}'), n AS (SELECT DISTINCT src, dst FROM links WHERE seen_at >= TIMESTAMP '{SPLIT}')"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    all_ = links(spark, d)
    at = F.lit(SPLIT).cast("timestamp_ntz")
    return all_.where(F.col("seen_at") < at), all_.where(F.col("seen_at") >= at)


@query("replaced_links", f"""
WITH {SNAPSHOTS_SQL}, dropped AS (
  SELECT o.dst AS dab, o.src FROM o WHERE o.dst IN (SELECT dab FROM cands) AND o.dst IN (SELECT dst FROM n)
  AND NOT EXISTS (SELECT 1 FROM n WHERE n.src = o.src AND n.dst = o.dst) AND NOT EXISTS (SELECT 1 FROM cands c WHERE c.dab = o.dst AND c.candidate = o.src)
), w AS (
  SELECT d.dab, d.src, list_sort(list(DISTINCT c.candidate) FILTER (EXISTS (SELECT 1 FROM o WHERE o.src = d.src AND o.dst = c.candidate))) AS old_links,
    list_sort(list(DISTINCT c.candidate) FILTER (EXISTS (SELECT 1 FROM n WHERE n.src = d.src AND n.dst = c.candidate))) AS new_links
  FROM dropped d JOIN cands c ON c.dab = d.dab GROUP BY d.dab, d.src
)
SELECT dab, src, coalesce(old_links, []) AS old_links, new_links FROM w WHERE NOT list_has_all(coalesce(old_links, []), new_links)
""")  # fmt: skip
def replaced_links(spark: SparkSession, d: str) -> DataFrame:
    o, n = _snapshots(spark, d)
    return evaluation.replaced_links(o, n, candidates(spark, d))


@query("dropped_label_links", f"""
WITH {SNAPSHOTS_SQL}, sets AS (SELECT src, dst, list_sort(list(DISTINCT text)) AS labels FROM labelled WHERE seen_at < TIMESTAMP '{SPLIT}' GROUP BY src, dst),
ix AS (SELECT text, dst FROM labelled GROUP BY text, dst), many AS (SELECT text FROM ix GROUP BY text HAVING count(*) > 1),
dropped AS (SELECT labels[1] AS text, dst AS dab, src FROM sets WHERE len(labels) = 1 AND labels[1] IN (SELECT text FROM many) AND NOT EXISTS (SELECT 1 FROM n WHERE n.src = sets.src AND n.dst = sets.dst)),
nl AS (SELECT d.text, d.dab, d.src, list_sort(list(DISTINCT n.dst)) AS new_links FROM dropped d JOIN n ON n.src = d.src JOIN ix ON ix.text = d.text AND ix.dst = n.dst GROUP BY ALL),
ol AS (SELECT d.text, d.dab, d.src, list_sort(list(DISTINCT o.dst)) AS old_links FROM dropped d JOIN o ON o.src = d.src JOIN ix ON ix.text = d.text AND ix.dst = o.dst GROUP BY ALL)
SELECT text, dab, src, coalesce(old_links, []) AS old_links, new_links FROM nl LEFT JOIN ol USING (text, dab, src) WHERE NOT list_has_all(coalesce(old_links, []), new_links)
""")  # fmt: skip
def dropped_label_links(spark: SparkSession, d: str) -> DataFrame:
    o, n = _snapshots(spark, d)
    rows = labelled(spark, d)
    old_sets = rows.where(F.col("seen_at") < F.lit(SPLIT).cast("timestamp_ntz")).select("src", "dst", F.array("text").alias("labels"))
    every = o.select("src", "dst").distinct().join(L.label_sets(old_sets), ["src", "dst"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    return evaluation.replaced_labels(every, n, L.label_index(rows))


HITS_SQL = f"""{CASES_SQL}, {BASELINE_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, class_idx) AS rank FROM baseline),
hits AS (SELECT c.case_id, max(b.score) AS score, CAST(coalesce(bool_or(a.member IS NOT NULL), false) AS INT) AS correct
  FROM cases c JOIN best b ON b.case_id = c.case_id AND b.rank <= 1 JOIN classes k ON k.class_id = c.class_id AND k.class_idx = b.class_idx
  LEFT JOIN answers a ON a.case_id = c.case_id AND a.member = k.member GROUP BY c.case_id)"""


def hits(spark: SparkSession, d: str, k: int = 1) -> DataFrame:
    c = Cases(spark, d)
    return evaluation.top_k_hits(evaluation.rank_classes(c.score("baseline")), c.classes, c.answered, k)


@query("topk_accuracy", f"WITH {HITS_SQL} SELECT CAST(sum(correct) AS BIGINT) AS correct, count(*) AS total, round(sum(correct) / count(*), 9) AS accuracy FROM hits")
def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.accuracy(hits(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


@query("roc_rows", f"WITH {HITS_SQL} SELECT correct, round(score, 9) AS score FROM hits")
def roc_rows(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("correct", F.round("score", 9).alias("score"))


@query("cumulative_precision", f"""
WITH {HITS_SQL}, r AS (SELECT row_number() OVER w AS n, sum(correct) OVER w AS s FROM (SELECT correct, case_id, round(score, 12) AS score FROM hits) WINDOW w AS (ORDER BY score DESC, case_id ROWS UNBOUNDED PRECEDING))
SELECT n, round(s / n, 9) AS precision FROM r
""")  # fmt: skip
def cumulative_precision(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).withColumn("score", F.round("score", 12))
    return evaluation.cumulative_precision(h).withColumn("precision", F.round("precision", 9))


@query("svm_rank_rows", f"""
WITH {CASES_SQL}, {BASELINE_SQL}, {LINK_TEXT_SQL}
SELECT CASE WHEN a.member IS NOT NULL THEN '1' ELSE '2' END || ' qid:' || c.case_id || ' 1:' || printf('%.6f', b.score) || ' 2:' || printf('%.6f', t.score) || ' # ' || c.src || ' -> ' || c.dab || ' -> ' || k.member AS line
FROM cases c JOIN classes k USING (class_id) JOIN baseline b ON b.case_id = c.case_id AND b.class_idx = k.class_idx JOIN link_text t ON t.case_id = c.case_id AND t.class_idx = k.class_idx LEFT JOIN answers a ON a.case_id = c.case_id AND a.member = k.member
""")  # fmt: skip
def svm_rank_rows(spark: SparkSession, d: str) -> DataFrame:
    c = Cases(spark, d)
    return evaluation.svm_rank_lines(c.answered, c.classes, [c.score("baseline"), c.score("link_text")])


# Topic model

STATE_SQL = f"""{TEXTS_SQL}, cands AS (SELECT DISTINCT src AS dab, dst AS candidate FROM links WHERE src IN (SELECT title FROM dabs)),
clist AS (SELECT dab, list(candidate ORDER BY candidate) AS l FROM cands GROUP BY dab),
state AS (SELECT src AS doc, link_id * 100 + k AS pos, dst IN (SELECT title FROM dabs) AS is_amb, dst AS target, text, (length(src) * 31 + length(dst) * 17 + link_id * 7 + k) % {TOPICS} AS topic,
  CASE WHEN dst IN (SELECT title FROM dabs) THEN l[(link_id + k) % len(l) + 1] END AS sampled, link_id, k FROM labelled LEFT JOIN clist ON dst = dab),
assigned AS (SELECT *, CASE WHEN is_amb THEN sampled ELSE target END AS w FROM state WHERE CASE WHEN is_amb THEN sampled ELSE target END IS NOT NULL)"""


def state(spark: SparkSession, d: str, iteration: int = 0) -> DataFrame:
    """A state that is the same in every engine: topics and candidates follow from ids and lengths."""
    rows = L.split_ambiguous(labelled(spark, d), table(spark, d, "dabs"))
    lists = candidates(spark, d).groupBy("dab").agg(F.array_sort(F.collect_list("candidate")).alias("_l"))
    rows = rows.join(lists, rows["dst"] == lists["dab"], "left")
    topic = F.pmod(F.length("src") * 31 + F.length("dst") * 17 + F.col("link_id") * 7 + F.col("k"), F.lit(TOPICS)).cast("int")
    sampled = F.when(F.col("is_amb"), F.try_element_at("_l", (F.pmod(F.col("link_id") + F.col("k") + iteration, F.size("_l")) + 1).cast("int")))
    return rows.select(F.col("src").alias("doc"), (F.col("link_id") * 100 + F.col("k")).alias("pos"), "is_amb", F.col("dst").alias("target"), "text", topic.alias("topic"), sampled.alias("sampled"))


@query("topic_article_counts", f"WITH {STATE_SQL} SELECT topic, w AS article, count(*) AS n FROM assigned GROUP BY topic, w HAVING count(*) > 10")
def topic_article_counts(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_articles(state(spark, d))


@query("topics_top50", f"""
WITH {STATE_SQL}, c AS (SELECT topic, w AS article, count(*) AS n FROM assigned GROUP BY topic, w HAVING count(*) > 10)
SELECT * FROM (SELECT topic, article, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, article) AS rank FROM c) WHERE rank <= 50
""")  # fmt: skip
def topics_top50(spark: SparkSession, d: str) -> DataFrame:
    return topics.top_articles(topics.topic_articles(state(spark, d)))


@query("sparse_topic_vectors", f"""
WITH {STATE_SQL}, c AS (SELECT w, topic, count(*) AS n FROM assigned GROUP BY w, topic) SELECT w, list(n || ' ' || topic ORDER BY n DESC, topic DESC) AS counts FROM c GROUP BY w
""")  # fmt: skip
def sparse_topic_vectors(spark: SparkSession, d: str) -> DataFrame:
    shown = F.transform("counts", lambda s: F.concat_ws(" ", s["n"].cast("string"), s["topic"].cast("string")))
    return topics.sparse_vectors(state(spark, d)).select("w", shown.alias("counts"))


@query("lda_topics")
def lda_topics(spark: SparkSession, d: str) -> DataFrame:
    """The topic vector of each page by latent Dirichlet allocation over its words."""
    from graphloom.operators.lda import topic_vectors

    return topic_vectors(bags(spark, d), topics=TOPICS, iterations=5)


@query("posterior_candidates", f"""
WITH {STATE_SQL}, size AS (SELECT count(DISTINCT w) AS v, count(DISTINCT text) AS t FROM assigned),
nt AS (SELECT topic, count(*) AS n FROM assigned GROUP BY topic), nwt AS (SELECT w, topic, count(*) AS n FROM assigned GROUP BY w, topic),
nwx AS (SELECT w, text, count(*) AS n FROM assigned GROUP BY w, text), nw AS (SELECT w, count(*) AS n FROM assigned GROUP BY w), ndt AS (SELECT doc, topic, count(*) AS n FROM assigned GROUP BY doc, topic),
rows AS (SELECT doc, pos, candidate AS cand, text, topic AS z, sampled AS a0 FROM state JOIN cands ON target = dab WHERE is_amb AND sampled IS NOT NULL),
cells AS (SELECT r.*, t.topic AS k FROM rows r, (SELECT unnest(range({TOPICS})) AS topic) t),
part AS (SELECT c.doc, c.pos, c.cand, c.text, c.a0, sum((coalesce(ndt.n, 0) - (c.k = z)::INT + 0.02) * (coalesce(nwt.n, 0) - (c.k = z AND c.cand = a0)::INT + 0.02) / (coalesce(nt.n, 0) - (c.k = z)::INT + 0.02 * v)) AS tp
  FROM cells c LEFT JOIN ndt ON ndt.doc = c.doc AND ndt.topic = c.k LEFT JOIN nwt ON nwt.w = c.cand AND nwt.topic = c.k LEFT JOIN nt ON nt.topic = c.k, size GROUP BY c.doc, c.pos, c.cand, c.text, c.a0),
s AS (SELECT p.doc, p.pos, p.cand, tp * (coalesce(nwx.n, 0) - (p.cand = a0)::INT + 0.02) / (coalesce(nw.n, 0) - 1 + 0.02 * t) AS s FROM part p LEFT JOIN nwx ON nwx.w = p.cand AND nwx.text = p.text LEFT JOIN nw ON nw.w = p.cand, size)
SELECT doc, pos, cand, round(s / sum(s) OVER (PARTITION BY doc, pos), 6) AS p FROM s
""")  # fmt: skip
def posterior_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = cut(state(spark, d))
    c = candidates(spark, d).select(F.col("dab").alias("key"), F.col("candidate").alias("cand"))
    return topics.posterior(s, c, topics.Params(TOPICS)).withColumn("p", F.round("p", 6))


@query("sample_average", f"""
WITH {STATE_SQL}, it AS (SELECT src AS doc, dst AS dab, link_id * 100 + k AS pos, l[(link_id + k + i) % len(l) + 1] AS cand FROM labelled JOIN clist ON dst = dab, (SELECT unnest(range(1, 6)) AS i)),
n AS (SELECT doc, dab, pos, cand, count(*) AS n FROM it GROUP BY ALL), last AS (SELECT doc, dab, max(pos) AS pos FROM n GROUP BY doc, dab)
SELECT doc, dab, cand, round(n / sum(n) OVER (PARTITION BY doc, dab), 9) AS p FROM n JOIN last USING (doc, dab, pos)
""")  # fmt: skip
def sample_average(spark: SparkSession, d: str) -> DataFrame:
    return _averages(spark, d).withColumn("p", F.round("p", 9))


def _averages(spark: SparkSession, d: str) -> DataFrame:
    samples = None
    for i in range(1, 6):
        s = state(spark, d, i).where("is_amb").withColumn("iteration", F.lit(i))
        samples = s if samples is None else samples.unionByName(s)
    return topics.average_samples(samples)


HIST_SQL = " UNION ALL ".join(f"SELECT '{k}' AS kind, value, count(*) AS freq FROM (SELECT count(*) AS value FROM assigned GROUP BY {by}) GROUP BY value" for k, by in (("doc", "doc"), ("topic", "topic"), ("article", "w"), ("doc_topic", "doc, topic"), ("article_topic", "w, topic")))


# The parts of the state behind what the cases have too.
MODEL_SQL = "clist AS " + STATE_SQL.split("clist AS ", 1)[1]


@query("gibbs_scores", f"""
WITH {CASES_SQL}, {MODEL_SQL}, it AS (SELECT src AS doc, dst AS dab, link_id * 100 + k AS pos, l[(link_id + k + i) % len(l) + 1] AS cand FROM labelled JOIN clist ON dst = dab, (SELECT unnest(range(1, 6)) AS i)),
n AS (SELECT doc, dab, pos, cand, count(*) AS n FROM it GROUP BY ALL), last AS (SELECT doc, dab, max(pos) AS pos FROM n GROUP BY doc, dab),
average AS (SELECT doc AS src, dab, cand AS member, n / sum(n) OVER (PARTITION BY doc, dab) AS p FROM n JOIN last USING (doc, dab, pos))
SELECT case_id, class_idx, round(CASE WHEN p = 1 THEN 0 ELSE coalesce(p, 0) END, 6) AS score FROM cases c JOIN classes k USING (class_id) LEFT JOIN average a ON a.src = c.src AND a.dab = c.dab AND a.member = k.member
""")  # fmt: skip
def gibbs_scores(spark: SparkSession, d: str) -> DataFrame:
    c = Cases(spark, d)
    c.context.samples = _averages(spark, d)
    return c.score("gibbs").select("case_id", "class_idx", F.round("score", 6).alias("score"))


@query("lda_scores", f"""
WITH {CASES_SQL}, {MODEL_SQL}, n AS (SELECT doc, topic, count(*) AS n FROM assigned GROUP BY doc, topic), whole AS (SELECT doc, sum(n) AS s FROM n GROUP BY doc),
k AS (SELECT unnest(range({TOPICS})) AS topic), v AS (SELECT doc, topic, (coalesce(n, 0) + 0.02) / (s + 0.02 * {TOPICS}) AS x FROM whole CROSS JOIN k LEFT JOIN n USING (doc, topic)),
m AS (SELECT case_id, class_idx, k.topic, coalesce(a.x, 1 / {TOPICS}) AS x, CASE WHEN member = dab THEN 1 / {TOPICS} ELSE coalesce(b.x, 1 / {TOPICS}) END AS y
  FROM cases JOIN classes USING (class_id) CROSS JOIN k LEFT JOIN v a ON a.doc = src AND a.topic = k.topic LEFT JOIN v b ON b.doc = member AND b.topic = k.topic)
SELECT case_id, class_idx, round(-sum(x * ln(x / y)), 6) + 0 AS score FROM m GROUP BY case_id, class_idx
""")  # fmt: skip
def lda_scores(spark: SparkSession, d: str) -> DataFrame:
    """By the topics of a page's links, each count smoothed by 0.02, as its vector."""
    c = Cases(spark, d, length=TOPICS)
    n = topics.document_topics(state(spark, d)).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("_n"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(TOPICS - 1)), lambda k: F.coalesce(F.element_at("_n", k), F.lit(0)) + F.lit(0.02))
    c.context.vectors = n.select(F.col("doc").alias("title"), vec.alias("vec"))
    return c.score("lda").select("case_id", "class_idx", (F.round("score", 6) + 0).alias("score"))


@query("param_histograms", f"WITH {STATE_SQL} {HIST_SQL}")
def param_histograms(spark: SparkSession, d: str) -> DataFrame:
    return topics.length_histograms(cut(state(spark, d)))


@query("dirichlet_step", f"""
WITH {STATE_SQL}, hist AS ({HIST_SQL}), c AS (SELECT value, freq FROM hist WHERE kind = 'topic'), e AS (SELECT value, freq FROM hist WHERE kind = 'article_topic'), v AS (SELECT CAST(count(DISTINCT w) AS DOUBLE) AS v FROM assigned),
m AS (SELECT unnest(range(1, (SELECT max(value) FROM hist) + 1)) AS m), h AS (SELECT m, sum(1 / (0.02 + m - 1)) OVER (ORDER BY m) AS small, sum(1 / (0.02 * v + m - 1)) OVER (ORDER BY m) AS whole FROM m, v)
SELECT round(0.02 * (SELECT sum(freq * small) FROM e JOIN h ON m = value) / (SELECT sum(freq * whole) FROM c JOIN h ON m = value), 6) AS param
""")  # fmt: skip
def dirichlet_step(spark: SparkSession, d: str) -> DataFrame:
    """One fixed-point step of the sum of the articles' parameters."""
    s = cut(state(spark, d))
    by: dict[str, dict[int, int]] = {}
    for r in topics.length_histograms(s).where(F.col("kind").isin("topic", "article_topic")).collect():  # distinct counts only
        by.setdefault(r["kind"], {})[r["value"]] = r["freq"]
    v = topics.vocabulary(s)[0]
    return spark.createDataFrame([(round(symmetric_step(0.02 * v, v, by.get("topic", {}), by.get("article_topic", {})), 6) if v else None,)], "param double")


@query("gibbs_sweep")
def gibbs_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The deterministic state after one sweep of the sampler."""
    s = cut(state(spark, d))
    c = candidates(spark, d).select(F.col("dab").alias("key"), F.col("candidate").alias("cand"))
    return topics.sweep(s, c, topics.Params(TOPICS), 1)


@query("gibbs_average")
def gibbs_average(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of ambiguous links by three sweeps from a random start."""
    rows = state(spark, d).select("doc", "pos", "is_amb", "target", "text")
    c = cut(candidates(spark, d).select(F.col("dab").alias("key"), F.col("candidate").alias("cand")))
    _, kept, _ = topics.train(cut(rows), c, topics.Params(TOPICS), 3, seed=7, keep_rate=1)
    return topics.average_samples(kept)


@query("dirichlet_fit")
def dirichlet_fit(spark: SparkSession, d: str) -> DataFrame:
    p = topics.refit(cut(state(spark, d)), topics.Params(TOPICS))
    return spark.createDataFrame([(p.alpha, p.beta, p.gamma)], "alpha array<double>, beta double, gamma double")


# Walks


@query("walk_power_3", f"""
WITH {LINKS_SQL}, e AS (SELECT DISTINCT src, dst FROM links), deg AS (SELECT src, count(*) AS n FROM e GROUP BY src),
f0 AS (SELECT DISTINCT src AS start, src AS node, 1.0::DOUBLE AS w FROM e),
f1 AS (SELECT start, dst AS node, sum(0.5 * w / n) AS w FROM f0 JOIN e ON node = e.src JOIN deg ON deg.src = e.src WHERE w >= 0.02 GROUP BY start, dst),
f2 AS (SELECT start, dst AS node, sum(0.5 * w / n) AS w FROM f1 JOIN e ON node = e.src JOIN deg ON deg.src = e.src WHERE w >= 0.02 GROUP BY start, dst)
SELECT start, node, round(sum(0.5 * w), 9) AS score FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY start, node
""")  # fmt: skip
def walk_power_3(spark: SparkSession, d: str) -> DataFrame:
    e = cut(links(spark, d).select("src", "dst").distinct())
    starts = e.select(F.col("src").alias("start")).distinct()
    return level_walks(e, starts, alpha=0.5, tol=0.02, levels=3).select("start", "node", F.round("score", 9).alias("score"))


@query("walk_exact")
def walk_exact(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return exact_walks(e, e.select(F.col("src").alias("start")).distinct())


@query("walk_scores")
def walk_scores(spark: SparkSession, d: str) -> DataFrame:
    """Not rounded: far candidates have scores down to the tolerance, 1e-7."""
    return Cases(spark, d).score("walk").select("case_id", "class_idx", "score")


@query("walk_radius_scores")
def walk_radius_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, "walk_radius")


@query("neighbour_features", f"""
WITH {LINKS_SQL}, e AS (SELECT DISTINCT src, dst FROM links), s AS (SELECT src, dst AS dab FROM e WHERE dst IN (SELECT title FROM dabs)),
p AS (SELECT dab, src, e.dst AS picked, row_number() OVER (PARTITION BY dab, src ORDER BY md5(concat_ws(chr(1), '0', src, e.dst)), e.dst) AS r FROM s JOIN e USING (src) WHERE e.dst <> dab)
SELECT dab, p.src, picked, e.src AS feature FROM p JOIN e ON e.dst = picked WHERE r = 1
""")  # fmt: skip
def neighbour_features(spark: SparkSession, d: str) -> DataFrame:
    return L.neighbour_features(edges(spark, d), table(spark, d, "dabs"))


# Trigrams and wikitext

GRAMS_SQL = """t AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS t FROM documents), i AS (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM t),
grams AS (SELECT t[i] AS t1, t[i + 1] AS t2, t[i + 2] AS t3, count(*) AS n FROM i GROUP BY ALL), fof AS (SELECT n AS r, count(*) AS n_r FROM grams GROUP BY n)"""


def grams(spark: SparkSession, d: str) -> DataFrame:
    return counting.trigram_counts(counting.trigrams(table(spark, d, "documents"), "doc_id", "text"))


@query("trigram_counts", f"WITH {GRAMS_SQL} SELECT * FROM grams")
def trigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return grams(spark, d)


@query("freq_of_freq", f"WITH {GRAMS_SQL} SELECT * FROM fof")
def freq_of_freq(spark: SparkSession, d: str) -> DataFrame:
    return counting.frequency_of_frequencies(grams(spark, d))


@query("good_turing_z", f"""
WITH {GRAMS_SQL}, z AS (SELECT r, n_r, 2 * n_r / (coalesce(lead(r) OVER w, 2 * r - lag(r, 1, 0) OVER w) - lag(r, 1, 0) OVER w) AS z_r FROM fof WINDOW w AS (ORDER BY r))
SELECT r, n_r, round(z_r, 9) AS z_r FROM z
""")  # fmt: skip
def good_turing_z(spark: SparkSession, d: str) -> DataFrame:
    return counting.averaged_frequencies(counting.frequency_of_frequencies(grams(spark, d))).withColumn("z_r", F.round("z_r", 9))


@query("good_turing_model", f"""
WITH {GRAMS_SQL}, z AS (SELECT r, n_r, 2 * n_r / (coalesce(lead(r) OVER w, 2 * r - lag(r, 1, 0) OVER w) - lag(r, 1, 0) OVER w) AS z_r FROM fof WINDOW w AS (ORDER BY r)),
line AS (SELECT regr_slope(ln(z_r), ln(r)) AS b, sum(r * n_r) AS total, coalesce(max(n_r) FILTER (r = 1), 0) AS n1 FROM z),
s AS (SELECT z.r, z.n_r, (z.r + 1) * exp(b * ln(z.r + 1)) / exp(b * ln(z.r)) AS y, (z.r + 1.0) * m.n_r / z.n_r AS x, 1.96 * (z.r + 1) / z.n_r * sqrt(m.n_r * (1 + m.n_r / z.n_r)) AS most FROM z LEFT JOIN z m ON m.r = z.r + 1, line),
star AS (SELECT r, n_r, CASE WHEN bool_and(coalesce(abs(x - y) < most, false)) OVER (ORDER BY r) THEN x ELSE y END AS v FROM s)
SELECT r, round((1 - n1 / total) * v / sum(n_r * v) OVER (), 10) AS p, round(n1 / total, 10) AS p0 FROM star, line
""")  # fmt: skip
def good_turing_model(spark: SparkSession, d: str) -> DataFrame:
    m = counting.good_turing_table(counting.frequency_of_frequencies(grams(spark, d)))
    return m.select("r", F.round("p", 10).alias("p"), F.round("p0", 10).alias("p0"))


LINK_SQL = r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]([a-z]*)"
UNESCAPE_SQL = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"


@query("wiki_links", rf"""
WITH r AS (SELECT DISTINCT id, text FROM revisions), m AS (SELECT id, unnest(regexp_extract_all(text, '{LINK_SQL}')) AS raw, generate_subscripts(regexp_extract_all(text, '{LINK_SQL}'), 1) - 1 AS pos FROM r),
p AS (SELECT id, pos, raw, {UNESCAPE_SQL.format(f"regexp_extract(raw, '{LINK_SQL}', 1)")} AS target, {UNESCAPE_SQL.format(f"regexp_extract(raw, '{LINK_SQL}', 2)")} AS shown, regexp_extract(raw, '{LINK_SQL}', 3) AS trail FROM m),
q AS (SELECT *, starts_with(trim(target), ':') AS colon, regexp_replace(target, '^\s*:', '') AS bare FROM p),
s AS (SELECT *, trim(regexp_replace(regexp_replace(bare, '#.*', '', 's'), '[\s_]+', ' ', 'g')) AS t0 FROM q), t AS (SELECT *, upper(substr(t0, 1, 1)) || substr(t0, 2) AS title FROM s)
SELECT id, pos, raw, title, CASE WHEN instr(bare, '#') > 0 THEN replace(trim(regexp_replace(bare, '^[^#]*#', '', 's')), ' ', '_') END AS anchor,
  trim(regexp_replace(CASE WHEN instr(raw, '|') = 0 THEN target WHEN trim(shown) = '' THEN trim(regexp_replace(regexp_replace(title, '^[^:]*:', ''), '\s*\([^()]*\)$', '')) ELSE shown END || trail, '\s+', ' ', 'g')) AS display, colon, trail FROM t
""")  # fmt: skip
def wiki_links(spark: SparkSession, d: str) -> DataFrame:
    return extract_links(table(spark, d, "revisions").dropDuplicates(["id"]), "id", "text")


PLACED_SQL = rf"""keyed AS ({PAGE_KEY_SQL}), langs AS (SELECT DISTINCT lang FROM namespaces),
names AS (SELECT DISTINCT lang, ns_id, lower(name) AS name FROM namespaces WHERE name <> ''),
r AS (SELECT key, text FROM (SELECT DISTINCT id, page_id, text FROM revisions WHERE text IS NOT NULL) x JOIN (SELECT DISTINCT id, key FROM keyed WHERE key IS NOT NULL) k ON x.page_id = k.id),
m AS (SELECT key, text, unnest(regexp_extract_all(text, '{LINK_SQL}')) AS raw, generate_subscripts(regexp_extract_all(text, '{LINK_SQL}'), 1) - 1 AS pos FROM ({{rows}})),
p AS (SELECT key, text, pos, raw, {UNESCAPE_SQL.format(f"regexp_extract(raw, '{LINK_SQL}', 1)")} AS target, {UNESCAPE_SQL.format(f"regexp_extract(raw, '{LINK_SQL}', 2)")} AS shown, regexp_extract(raw, '{LINK_SQL}', 3) AS trail FROM m),
q AS (SELECT *, starts_with(trim(target), ':') AS colon, trim(regexp_replace(regexp_replace(regexp_replace(target, '^\s*:', ''), '#.*', '', 's'), '[\s_]+', ' ', 'g')) AS t0 FROM p),
t AS (SELECT *, split_part(key, ':', 1) AS own, upper(substr(t0, 1, 1)) || substr(t0, 2) AS title FROM q),
d AS (SELECT *, trim(regexp_replace(CASE WHEN instr(raw, '|') = 0 THEN target WHEN trim(shown) = '' THEN trim(regexp_replace(regexp_replace(title, '^[^:]*:', ''), '\s*\([^()]*\)$', '')) ELSE shown END || trail, '\s+', ' ', 'g')) AS display,
  CASE WHEN lower(split_part(title, ':', 1)) IN (SELECT lang FROM langs) THEN title ELSE own || ':' || title END AS whole FROM t),
f AS (SELECT *, substr(whole, instr(whole, ':') + 1) AS rest, CASE WHEN instr(whole, ':') > 0 AND lower(split_part(whole, ':', 1)) IN (SELECT lang FROM langs) THEN lower(split_part(whole, ':', 1)) END AS language FROM d),
g AS (SELECT f.*, coalesce(n.ns_id, 0) AS namespace_id, trim(regexp_replace(CASE WHEN n.ns_id IS NOT NULL THEN substr(rest, instr(rest, ':') + 1) WHEN f.language IS NOT NULL THEN rest ELSE whole END, '[\s_]+', ' ', 'g')) AS short0
  FROM f LEFT JOIN names n ON f.language = n.lang AND instr(rest, ':') > 0 AND lower(split_part(rest, ':', 1)) = n.name),
placed AS (SELECT *, upper(substr(short0, 1, 1)) || substr(short0, 2) AS short_title, NOT colon AND (language IS DISTINCT FROM own OR namespace_id IN (6, 14)) AS hidden FROM g)"""
#: Links with what stands before each, its length and that of what the link shows.
SHOWN_SQL = PLACED_SQL.replace("{rows}", "SELECT DISTINCT * FROM r") + rf""",
pieces AS (SELECT key, text, pos, display, hidden, regexp_split_to_array(text, '{LINK_SQL}') AS between FROM placed),
lengths AS (SELECT *, CASE WHEN hidden THEN '' ELSE display END AS out FROM pieces)"""


@query("link_offsets", f"""
WITH {SHOWN_SQL} SELECT key, pos, sum(length(between[pos + 1]) + length(out)) OVER (PARTITION BY key, text ORDER BY pos) - length(out) AS "offset", out AS display, hidden FROM lengths
""")  # fmt: skip
def link_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each link stands in the text in which links are replaced by what they show."""
    x = _shown(spark, d).select(F.col("page").alias("key"), F.posexplode("links").alias("pos", "_l"))
    return x.select("key", F.col("pos").cast("bigint").alias("pos"), F.col("_l.offset").cast("bigint").alias("offset"), "_l.display", "_l.hidden")


@query("linkless_texts", f"""
WITH {SHOWN_SQL}, joined AS (SELECT key, text, string_agg(between[pos + 1] || out, '' ORDER BY pos) || max(between[len(between)]) AS t FROM lengths GROUP BY key, text)
SELECT key, coalesce(t, text) AS text FROM (SELECT DISTINCT * FROM r) LEFT JOIN joined USING (key, text)
""")  # fmt: skip
def linkless_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text with links replaced by what they show."""
    return _shown(spark, d).select(F.col("page").alias("key"), "text")


def _shown(spark: SparkSession, d: str) -> DataFrame:
    keyed = page_keys(table(spark, d, "pages"), table(spark, d, "namespaces"), "id").distinct().withColumnRenamed("id", "page_id")
    r = table(spark, d, "revisions").dropDuplicates(["id"]).join(keyed, "page_id").select("key", "text")
    return links_to_text(r, "key", "text", table(spark, d, "namespaces"))


@query("wiki_redirects", r"""
WITH r AS (SELECT DISTINCT id, regexp_extract(text, '(?is)\A\s*#REDIRECT\s*\[\[(.*?)\]\]', 1) AS target FROM revisions WHERE regexp_matches(text, '(?is)\A\s*#REDIRECT\s*\[\[(.*?)\]\]')) SELECT id, target FROM r
""")  # fmt: skip
def wiki_redirects(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "revisions").where(is_redirect(F.col("text")))
    return r.select("id", redirect_target(F.col("text")).alias("target")).distinct()


@query("wiki_sections", r"""
WITH r AS (SELECT DISTINCT id, text FROM revisions WHERE text IS NOT NULL), l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM r),
h AS (SELECT *, regexp_matches(line, '^={2,6}[ \t]*[^\n]*?[^=\n][ \t]*={2,6}[ \t\r]*$') AS head FROM l),
n AS (SELECT *, CAST(count(*) FILTER (head) OVER (PARTITION BY id ORDER BY i) AS BIGINT) AS pos FROM h),
every AS (SELECT DISTINCT id, pos FROM n UNION SELECT id, 0 FROM r)
SELECT id, pos, coalesce(length(max(regexp_extract(line, '^(={2,6})[ \t]*([^\n]*?[^=\n])[ \t]*={2,6}[ \t\r]*$', 1)) FILTER (head)), 0)::INT AS level,
  trim(max(regexp_extract(line, '^(={2,6})[ \t]*([^\n]*?[^=\n])[ \t]*={2,6}[ \t\r]*$', 2)) FILTER (head)) AS title, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), '') AS text
FROM every LEFT JOIN n USING (id, pos) GROUP BY id, pos
""")  # fmt: skip
def wiki_sections(spark: SparkSession, d: str) -> DataFrame:
    return split_sections(table(spark, d, "revisions").where("text IS NOT NULL").dropDuplicates(["id"]), "id", "text")


@query("list_lines", r"""
WITH r AS (SELECT DISTINCT id, text FROM revisions WHERE text IS NOT NULL), l AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM r) SELECT id, line FROM l WHERE regexp_matches(line, '^[:#*]')
""")  # fmt: skip
def list_lines_(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "revisions").where("text IS NOT NULL").dropDuplicates(["id"])
    return r.select("id", F.explode(list_lines(F.col("text"))).alias("line"))
