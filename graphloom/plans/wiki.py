"""Queries of wikitext parsing, classification and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import CANONICAL_SQL, page_keys
from graphloom.functions.text import without_comments, without_language
from graphloom.functions.wikitext import admitted_links, dab_template, evaluate, expand_templates, extract_links, is_redirect, split_title, strip_wiki_column
from graphloom.operators import counting
from graphloom.plans.graph import PLACED_SQL
from graphloom.registry import Registry
from graphloom.session import cut
from graphloom.sources.dump import DEFAULT_NAMESPACES, NAMESPACE_ALIASES, effective_namespaces
from graphloom.sources.tables import table
from graphloom.streaming.links import read_stream, run_available, windowed_targets

registry = Registry()
query = registry.query


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "revisions").where("text IS NOT NULL").dropDuplicates(["id"])


@query("plain_text")
def plain_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts of pages of the main namespace that are no redirects, without markup."""
    pages = table(spark, d, "pages").where("namespace_id = 0").select(F.col("id").alias("page_id")).distinct()
    r = _texts(spark, d).where(~is_redirect(F.col("text"))).join(pages, "page_id", "left_semi")
    return r.select("id", strip_wiki_column(F.col("text")).alias("text"))


@query("texts_without_comments", "SELECT DISTINCT id, regexp_replace(text, '<!--.*?-->', '', 'g') AS text FROM revisions WHERE text IS NOT NULL")
def texts_without_comments(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("id", without_comments(F.col("text")).alias("text"))


@query("dab_pages", r"""
SELECT id, t AS template FROM (SELECT DISTINCT id, regexp_extract(regexp_replace(text, '<!--.*?-->', '', 'g'), '(\{\{\s*(?:[Dd]isambig|[Dd]ab|[Hh]ndis|[Gg]eodis)\s*(?:\|[^{}]*)?\}\})', 1) AS t FROM revisions) WHERE t <> ''
""")  # fmt: skip
def dab_pages(spark: SparkSession, d: str) -> DataFrame:
    found = dab_template(F.col("text"), ["disambig", "dab", "hndis", "geodis"])
    return _texts(spark, d).select("id", found.alias("template")).where("template IS NOT NULL")


@query("admitted_links", f"""WITH {PLACED_SQL.replace("{rows}", "SELECT * FROM r")}
SELECT key, pos, language, namespace_id, short_title, display FROM placed WHERE (colon OR (language = own AND namespace_id NOT IN (6, 14))) AND length(short_title) <= 255
""")  # fmt: skip
def admitted(spark: SparkSession, d: str) -> DataFrame:
    """The links of each page's latest texts that lead to articles of its own language."""
    pages = page_keys(table(spark, d, "pages"), table(spark, d, "namespaces"), "id").distinct()
    r = _texts(spark, d)
    keyed = r.join(pages.withColumnRenamed("id", "page_id"), "page_id").select("key", "text")
    found = extract_links(keyed, "key", "text")
    own = F.substring_index("key", ":", 1)
    ns = table(spark, d, "namespaces")
    known = ns.select(F.col("lang").alias("_l")).distinct()
    named = found.join(known, F.lower(F.substring_index("title", ":", 1)) == F.col("_l"), "left")
    full = F.when(F.col("_l").isNotNull(), F.col("title")).otherwise(F.concat_ws(":", own, "title"))
    titled = split_title(named.withColumn("full", full).drop("_l"), "full", ns).withColumn("page_language", own)
    return admitted_links(titled).select("key", "pos", "language", "namespace_id", "short_title", "display")


_DEFAULTS = ", ".join(f"({i}, '{n}', true)" for i, n in DEFAULT_NAMESPACES.items()) + ", " + ", ".join(f"({i}, '{n}', false)" for n, i in NAMESPACE_ALIASES.items())


@query("effective_namespaces", f"""
WITH own AS (SELECT DISTINCT lang, ns_id, name FROM namespaces), d AS (SELECT * FROM (VALUES {_DEFAULTS}) AS t(ns_id, name, def)),
more AS (SELECT l.lang, d.ns_id, d.name, def AND NOT EXISTS (SELECT 1 FROM own o WHERE o.lang = l.lang AND o.ns_id = d.ns_id) AS main FROM (SELECT DISTINCT lang FROM own) l, d)
SELECT lang, ns_id, name, bool_or(main) AS main FROM (SELECT *, true AS main FROM own UNION ALL SELECT * FROM more) GROUP BY lang, ns_id, name
""")  # fmt: skip
def namespaces(spark: SparkSession, d: str) -> DataFrame:
    return effective_namespaces(table(spark, d, "namespaces"))


@query("titles_without_language", f"SELECT DISTINCT regexp_replace({CANONICAL_SQL}, '^[^:]*:', '') AS title FROM links_raw WHERE dst IS NOT NULL")
def titles_without_language(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.functions.keys import canonical_target

    return table(spark, d, "links_raw").where("dst IS NOT NULL").select(without_language(canonical_target(F.col("dst"))).alias("title")).distinct()


@query("template_expand")
def template_expand(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its templates expanded by a small library."""
    library = {"cite note": "(p. {{{page|?}}})", "dab": "May refer to several things.", "a": "{{{1|}}}", "b": "{{#ifexpr:{{{1}}} > 3|many|{{{1}}}}}"}
    keyed = page_keys(table(spark, d, "pages"), table(spark, d, "namespaces"), "id").distinct().withColumnRenamed("id", "page_id")
    r = _texts(spark, d).join(keyed, "page_id", "left").select("id", "key", "text")
    return expand_templates(r, "key", "text", library).select("id", "text")


@query("expr_eval", """
SELECT * FROM (VALUES ('1 + 2 * 3', 7.0::DOUBLE), ('(1 + 2) * 3', 9), ('7 div 2', 3.5), ('7 mod 4', 3), ('not 0 and 1', 1), ('2.345 round 2', 2.35), ('3 <> 4', 1), ('-2 + 5 >= 3 or 0', 1)) AS t(expression, value)
""")  # fmt: skip
def expr_eval(spark: SparkSession, d: str) -> DataFrame:
    cases = ["1 + 2 * 3", "(1 + 2) * 3", "7 div 2", "7 mod 4", "not 0 and 1", "2.345 round 2", "3 <> 4", "-2 + 5 >= 3 or 0"]
    return spark.createDataFrame([(c, evaluate(c)) for c in cases], "expression string, value double")


@query("language_classifier")
def language_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Which of two corpora, the English or the German documents, each document is more like."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.lower("lang").alias("lang")).where("text IS NOT NULL")
    docs = cut(docs)
    out = counting.classify(docs, docs.where("lang = 'en'"), docs.where("lang = 'de'"), "doc_id", "text", mode="standard")
    return out.select(F.col("doc").alias("doc_id"), "label")


@query("stream_target_windows", f"""
SELECT to_timestamp(floor(epoch(seen_at) / 2592000) * 2592000) AT TIME ZONE 'UTC' AS begin, dst, count(*) AS n
FROM (SELECT DISTINCT link_id, {CANONICAL_SQL} AS dst, seen_at FROM links_raw) GROUP BY ALL
""")  # fmt: skip
def stream_target_windows(spark: SparkSession, d: str) -> DataFrame:
    """Links per target and 30 days, read as a stream."""
    out = run_available(windowed_targets(read_stream(spark, d, "links_raw"), late="3650 days"), ["begin", "dst"])
    return out.select(F.col("begin").cast("timestamp_ntz").alias("begin"), "dst", "n")
