"""Queries p1 and p3: hot keys and orphan references of the link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import CANONICAL_SQL, LABEL_SQL, PAGE_KEY_SQL, canonical_target, label_text, page_keys
from graphloom.operators.orphans import find_orphans, orphan_report
from graphloom.operators.selection import heavy_keys, key_quantiles
from graphloom.registry import Registry
from graphloom.sources.tables import table

registry = Registry()
query = registry.query

HEAVY_SHARE = 0.02


def link_fields(links: DataFrame, *keep: str) -> DataFrame:
    """``field``, ``key`` and the columns ``keep``: a row per link with its canonical
    target ('dst', null if the target is) and one per label that isn't empty ('label')."""
    as_struct = lambda f, k: F.struct(F.lit(f).alias("field"), k.alias("key"))
    labels = F.filter(F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: as_struct("label", label_text(x))), lambda s: s["key"].isNotNull())
    both = F.concat(F.array(as_struct("dst", canonical_target(F.col("dst")))), labels)
    return links.select(F.explode(both).alias("_f"), *keep).select("_f.field", "_f.key", *keep)


FIELDS_SQL = f"""fields AS (
  SELECT 'dst' AS field, {CANONICAL_SQL} AS key, seen_at FROM links_raw
  UNION ALL SELECT 'label', k, seen_at FROM (SELECT {LABEL_SQL} AS k, seen_at FROM (SELECT unnest(labels) AS label, seen_at FROM links_raw)) WHERE k <> ''
)"""


@query("p1_found", f"""
WITH {FIELDS_SQL}, n AS (SELECT field, count(*) AS total FROM fields GROUP BY field)
SELECT field, key FROM fields JOIN n USING (field) WHERE key IS NOT NULL
GROUP BY field, key HAVING count(*) * 50 >= max(total)
""")  # fmt: skip
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(link_fields(table(spark, d, "links_raw")), "field", "key", HEAVY_SHARE).select("field", "key")


@query("p1_key_quantiles", f"""
WITH {FIELDS_SQL}, r AS (
  SELECT field, key, seen_at, row_number() OVER (PARTITION BY field, key ORDER BY seen_at) AS r, count(*) OVER (PARTITION BY field, key) AS n
  FROM fields WHERE key IS NOT NULL AND seen_at IS NOT NULL
)
SELECT field, key, n, p AS prob, seen_at FROM r, (VALUES (0.1), (0.5), (0.9)) AS q(p) WHERE r = greatest(1, ceil(p * n))
""")  # fmt: skip
def p1_key_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """When each target and each label was seen: the deciles 1, 5 and 9 of ``seen_at``."""
    fields = link_fields(table(spark, d, "links_raw"), "seen_at").where(F.col("key").isNotNull())
    return key_quantiles(fields, ["field", "key"], "seen_at", [0.1, 0.5, 0.9])


def orphans(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    keyed = page_keys(pages, table(spark, d, "namespaces"), "created_at", "deleted_at")
    revisions = table(spark, d, "revisions").select(F.lit("revisions").alias("tab"), F.col("id").alias("rec_id"), F.col("page_id").cast("string").alias("key"), F.col("saved_at").alias("at"))
    links = table(spark, d, "links_raw").select(F.lit("links_raw").alias("tab"), F.col("link_id").alias("rec_id"), canonical_target(F.col("dst")).alias("key"), F.col("seen_at").alias("at"))
    by_id = pages.select(F.lit("revisions").alias("tab"), F.col("id").cast("string").alias("key"), F.col("created_at").alias("valid_from"), F.col("deleted_at").alias("valid_to"))
    by_key = keyed.select(F.lit("links_raw").alias("tab"), "key", F.col("created_at").alias("valid_from"), F.col("deleted_at").alias("valid_to"))
    return find_orphans(revisions.unionByName(links), by_id.unionByName(by_key))


ORPHANS_SQL = f"""keyed AS ({PAGE_KEY_SQL}),
parents AS (
  SELECT 'revisions' AS tab, CAST(id AS VARCHAR) AS key, created_at, deleted_at FROM pages
  UNION ALL SELECT 'links_raw', key, created_at, deleted_at FROM keyed WHERE key IS NOT NULL
), refs AS (
  SELECT DISTINCT 'revisions' AS tab, id AS rec_id, CAST(page_id AS VARCHAR) AS key, saved_at AS at FROM revisions WHERE page_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'links_raw', link_id, {CANONICAL_SQL}, seen_at FROM links_raw WHERE dst IS NOT NULL
), cases AS (
  SELECT r.tab, r.rec_id, r.at, strftime(r.at, '%Y-%m') AS period,
    CASE WHEN count(p.key) = 0 THEN 'missing' WHEN max(p.created_at) > r.at THEN 'late' ELSE 'deleted' END AS state
  FROM refs r LEFT JOIN parents p ON r.tab = p.tab AND r.key = p.key
  GROUP BY r.tab, r.rec_id, r.key, r.at
  HAVING NOT coalesce(bool_or(p.created_at <= r.at AND (p.deleted_at IS NULL OR p.deleted_at > r.at)), false)
)"""


@query("p3_found", f"WITH {ORPHANS_SQL} SELECT DISTINCT tab, rec_id, period, state FROM cases")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(spark, d)


@query("p3_orphan_report", f"WITH {ORPHANS_SQL} SELECT tab, period, state, count(*) AS n FROM (SELECT DISTINCT tab, rec_id, period, state FROM cases) GROUP BY ALL")
def p3_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(orphans(spark, d))
