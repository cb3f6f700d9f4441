"""Queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import language_code
from graphloom.llm import bpe, frequent, leaks, markup, terms, truncation, wrappers
from graphloom.plans.general import FIELDS_SQL, link_fields
from graphloom.registry import Registry
from graphloom.session import cut
from graphloom.sources.tables import table

registry = Registry()
query = registry.query

TERMS_SQL = r"""one AS (SELECT DISTINCT id, text FROM revisions WHERE text IS NOT NULL),
words AS (SELECT id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM one),
tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY id, term),
stats AS (SELECT term, count(*) AS records, sum(tf) AS n, sum(tf * ln(tf)) AS h FROM tf GROUP BY term),
total AS (SELECT count(*) AS records FROM one)"""


def revision_terms(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    revisions = table(spark, d, "revisions")
    return terms.record_terms(revisions, "id", "text"), terms.count_records(revisions, "id", "text")


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.structured_pieces(table(spark, d, "revisions"))


@query("p2_clean")
def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every revision row with its clean text."""
    return markup.clean_texts(table(spark, d, "revisions"))


@query("p2_own_content")
def p2_own_content(spark: SparkSession, d: str) -> DataFrame:
    """Every revision without what the texts of its language have in common; the language of
    a page stands for the host, which these tables don't have. Revisions without a page or language are one host."""
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), language_code(F.col("language")).alias("host")).dropDuplicates(["page_id"])
    r = table(spark, d, "revisions").dropDuplicates(["id"])
    return wrappers.own_content(r.join(pages, "page_id", "left"), "id", "host", "text")


@query("p4_found", f"""
WITH {TERMS_SQL}, scored AS (
  SELECT id, term, round(tf.tf * (1 - ln(stats.records) / ln(total.records)), 12) AS w
  FROM tf JOIN stats USING (term), total WHERE stats.records >= 2
)
SELECT id, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY w DESC, term) AS r FROM scored) WHERE r = 1
""")  # fmt: skip
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    counts, n = revision_terms(spark, d)
    weights = terms.weigh_terms(cut(counts), n, local="count", spread="presence", least=2)
    return terms.most_characteristic(weights).select("id", "term")


@query("p4_log_entropy", f"""
WITH {TERMS_SQL}
SELECT id, term, tf.tf, round(ln(1 + tf.tf) * (1 - (ln(n) - h / n) / ln(total.records)), 6) AS weight
FROM tf JOIN stats USING (term), total
""")  # fmt: skip
def p4_log_entropy(spark: SparkSession, d: str) -> DataFrame:
    """The log-entropy weight of every term of every revision."""
    counts, n = revision_terms(spark, d)
    return terms.weigh_terms(cut(counts), n).select("id", "term", "tf", F.round("weight", 6).alias("weight"))


@query("p5_found", f"""
WITH {FIELDS_SQL}
SELECT field, key FROM (
  SELECT field, key, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, key) AS r
  FROM fields WHERE key IS NOT NULL GROUP BY field, key
) WHERE r <= 10
""")  # fmt: skip
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    top = frequent.top_values(link_fields(table(spark, d, "links_raw")), "field", "key", 10)
    return top.select(F.col("group").alias("field"), "key")


@query("p5_top_counts", f"""
WITH {FIELDS_SQL}
SELECT field, key, n FROM (
  SELECT field, key, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, key) AS r
  FROM fields WHERE key IS NOT NULL GROUP BY field, key
) WHERE r <= 100
""")  # fmt: skip
def p5_top_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the hundred most frequent targets and labels; the sketch's bounds of them differ by its split."""
    top = frequent.top_values(link_fields(table(spark, d, "links_raw")), "field", "key", 100)
    return top.select(F.col("group").alias("field"), "key", "n")


MARKS_SQL = f"""WITH {TERMS_SQL},
langs AS (SELECT id, lower(regexp_replace(language, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS term FROM (SELECT DISTINCT id, language FROM pages) WHERE language IS NOT NULL),
freq AS (
  SELECT 'revisions.text' AS field, term, CAST(n AS BIGINT) AS n, records, (SELECT records FROM total) AS of FROM stats
  UNION ALL SELECT 'pages.language', term, count(*), count(*), (SELECT count(*) FROM langs) FROM langs GROUP BY term
), marked AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records * 2 >= of THEN 'common' END AS mark FROM freq)"""


def frequencies(spark: SparkSession, d: str) -> DataFrame:
    """``field``, ``term``, ``n``, ``records``, ``mark`` of all terms of revisions and languages of pages."""
    counts, n = revision_terms(spark, d)
    text = terms.mark_frequencies(terms.term_frequencies(counts), n).select(F.lit("revisions.text").alias("field"), "*")
    pages = table(spark, d, "pages")
    langs = terms.value_frequencies(pages, "id", language_code(F.col("language")))
    n = pages.where(F.col("language").isNotNull()).select("id").distinct().count()
    return text.unionByName(terms.mark_frequencies(langs, n).select(F.lit("pages.language").alias("field"), "*"))


@query("p6_found", f"{MARKS_SQL} SELECT field, term, mark FROM marked WHERE mark IS NOT NULL")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return frequencies(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


@query("p6_frequencies", f"{MARKS_SQL} SELECT field, term, n, records, mark FROM marked")
def p6_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return frequencies(spark, d)


@query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p8_cleaned")
def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The documents with leaked passages taken out."""
    return leaks.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.text_stops(table(spark, d, "documents")).where("truncated").select(F.col("id").alias("doc_id"))


@query("p9_by_source")
def p9_by_source(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_by_source(truncation.text_stops(table(spark, d, "documents")))
