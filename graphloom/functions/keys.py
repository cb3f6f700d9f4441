"""Page keys, link targets and labels as column expressions.

All of them return null for null input and are plain built-in expressions, so
they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space and separators; Java and RE2 read the class alike.
SPACE = r"[\s\p{Z}]"


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def capitalize(c: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def canonical_target(dst: Column) -> Column:
    """``lang:Rest of the key`` for any spelling of a link target.

    The part before the first colon is trimmed and lower-cased; in the rest
    underscores and white space runs become one space, the ends are trimmed and
    the first character is upper-cased. A value without a colon has an empty rest.
    """
    head = F.lower(strip_space(F.substring_index(dst, ":", 1)))
    rest = F.when(F.instr(dst, ":") > 0, F.substring(dst, F.instr(dst, ":") + 1, F.lit(1 << 30))).when(dst.isNotNull(), F.lit(""))
    rest = F.trim(F.regexp_replace(rest, r"[_\s\p{Z}]+", " "))
    return F.concat(head, F.lit(":"), capitalize(rest))


def label_text(label: Column) -> Column:
    """Lower-cased runs of letters and digits joined by one space; null if there are none."""
    s = F.trim(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", " "))
    return F.when(s != "", s)


def language_code(c: Column) -> Column:
    return F.lower(strip_space(c))


def page_keys(pages: DataFrame, namespaces: DataFrame, *keep: str) -> DataFrame:
    """``key`` and the columns ``keep`` for each page that has a key.

    A page has none when its language is null or unknown, or its namespace or
    title is null. Spark broadcasts ``namespaces`` if its size is under
    ``spark.sql.autoBroadcastJoinThreshold``, else it joins by shuffle.
    """
    ns = namespaces.select(F.col("lang").alias("_lang"), F.col("ns_id").alias("_ns"), F.col("name").alias("_name")).dropDuplicates(["_lang", "_ns"])
    p = pages.select(language_code(F.col("language")).alias("_l"), F.col("namespace_id").alias("_n"), F.translate("title", "_", " ").alias("_title"), *keep)
    prefix = F.when(F.col("_n") == 0, F.col("_l")).otherwise(F.concat_ws(":", "_l", F.coalesce("_name", F.lit(""))))
    return p.join(ns, (p["_l"] == ns["_lang"]) & (p["_n"] == ns["_ns"])).where(F.col("_title").isNotNull()).select(F.concat(prefix, F.lit(":"), "_title").alias("key"), *keep)


#: The same in the dialect of the SQL check.
CANONICAL_SQL = r"""lower(regexp_replace(split_part(dst, ':', 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) || ':' ||
  upper(substr(trim(regexp_replace(substr(dst, instr(dst || ':', ':') + 1), '[_\s\p{Z}]+', ' ', 'g')), 1, 1)) ||
  substr(trim(regexp_replace(substr(dst, instr(dst || ':', ':') + 1), '[_\s\p{Z}]+', ' ', 'g')), 2)"""
LABEL_SQL = r"trim(regexp_replace(lower(label), '[^\p{L}\p{N}]+', ' ', 'g'))"
PAGE_KEY_SQL = r"""SELECT p.id, p.created_at, p.deleted_at,
  CASE WHEN p.namespace_id = 0 THEN n.lang ELSE n.lang || ':' || n.name END || ':' || replace(p.title, '_', ' ') AS key
  FROM pages p JOIN (SELECT DISTINCT lang, ns_id, name FROM namespaces) n
  ON lower(regexp_replace(p.language, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) = n.lang AND p.namespace_id = n.ns_id"""
