"""Readers of wiki dumps and topic vectors, and writers of the stored relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.ranking import rank_within

#: Fixed value: how dump files are named.
DUMP_NAME = r"([a-z]+)wiki-(\d+)-pages-articles\.xml"
#: Namespaces every wiki has, by id, where a dump names none.
DEFAULT_NAMESPACES = {-2: "Media", -1: "Special", 0: "", 1: "Talk", 2: "User", 3: "User talk", 4: "Project", 5: "Project talk", 6: "File", 7: "File talk", 8: "MediaWiki", 9: "MediaWiki talk", 10: "Template", 11: "Template talk", 12: "Help", 13: "Help talk", 14: "Category", 15: "Category talk"}
#: Other names of the same namespaces.
NAMESPACE_ALIASES = {"Image": 6, "Image talk": 7}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``lang``, ``date``, ``title``, ``text``: the pages of all dumps below ``path``, plain, gzip or bzip2.

    Only files named like ``enwiki-20120101-pages-articles.xml`` are read; language and
    date come from the name.
    """
    raw = spark.read.format("xml").option("rowTag", "page").option("recursiveFileLookup", "true").option("pathGlobFilter", "*wiki-*-pages-articles.xml*").schema("title string, revision struct<text: string>").load(path)
    name = F.col("_metadata.file_path")
    d = raw.select(F.regexp_extract(name, DUMP_NAME, 1).alias("lang"), F.regexp_extract(name, DUMP_NAME, 2).alias("date"), "title", F.col("revision.text").alias("text"))
    return d.where("lang <> ''")


def read_namespaces(spark: SparkSession, path: str) -> DataFrame:
    """``lang``, ``ns_id``, ``name`` of all dumps below ``path``; the main namespace has an empty name."""
    raw = spark.read.format("xml").option("rowTag", "namespace").option("attributePrefix", "_").option("recursiveFileLookup", "true").option("pathGlobFilter", "*wiki-*-pages-articles.xml*").schema("_key int, _VALUE string").load(path)
    lang = F.regexp_extract(F.col("_metadata.file_path"), DUMP_NAME, 1)
    return raw.select(lang.alias("lang"), F.col("_key").alias("ns_id"), F.coalesce("_VALUE", F.lit("")).alias("name")).where("lang <> '' AND ns_id IS NOT NULL").distinct()


def effective_namespaces(namespaces: DataFrame) -> DataFrame:
    """``lang``, ``ns_id``, ``name``, ``main``: the dump's names (``main`` true where the id shows by it),
    the default names, main only for ids that the dump has not, and the aliases."""
    own = namespaces.select("lang", "ns_id", "name").distinct()
    rows = [(i, n, True) for i, n in DEFAULT_NAMESPACES.items()] + [(i, n, False) for n, i in NAMESPACE_ALIASES.items()]
    extra = F.explode(F.array(*[F.struct(F.lit(i).alias("ns_id"), F.lit(n).alias("name"), F.lit(d).alias("_default")) for i, n, d in rows])).alias("_e")
    more = own.select("lang").distinct().select("lang", extra).select("lang", "_e.*")
    have = own.select("lang", "ns_id", F.lit(True).alias("_has")).distinct()
    more = more.join(have, ["lang", "ns_id"], "left").select("lang", "ns_id", "name", (F.col("_default") & F.col("_has").isNull()).alias("main"))
    all_ = own.withColumn("main", F.lit(True)).unionByName(more)
    return all_.groupBy("lang", "ns_id", "name").agg(F.max("main").alias("main"))


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    """``lang``: one code per line, blank lines left out; the list is the caller's file."""
    return spark.read.text(path).select(F.trim("value").alias("lang")).where("lang <> ''").distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``pos``, ``value``: the lines of all files below ``path``, numbered from 0 per file.

    Files are read in splits; a line's number comes from its split and its place there.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    return rank_within(placed, ["file"], ["_block", "_at"]).select("file", (F.col("rank") - 1).alias("pos"), "value")


def read_vectors(spark: SparkSession, labels: DataFrame, path: str, skip_first: bool) -> DataFrame:
    """``title``, ``vec``: lines of numbers paired by position with ``labels`` (``pos`` from 0, ``title``).

    ``skip_first`` drops the first token of each line. Lines without a label and
    labels without a line are left out.
    """
    lines = read_lines(spark, path).select("pos", F.split(F.trim("value"), r"\s+").alias("_t"))
    values = F.slice("_t", 2, F.size("_t")) if skip_first else F.col("_t")
    return lines.select("pos", F.transform(values, lambda x: x.cast("double")).alias("vec")).join(labels, "pos").select("title", "vec")


def write_sorted(df: DataFrame, path: str, *keys: str, mode: str = "errorifexists") -> None:
    """Parquet sorted by ``keys``: a point or prefix lookup reads only the matching row groups."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).option("compression", "zstd").parquet(path)


def lookup(df: DataFrame, key: str, *values: str) -> DataFrame:
    """The rows of these keys; the filter reaches the scan."""
    return df.where(F.col(key).isin(*values))


def lookup_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """The rows whose key begins with ``prefix``; of files sorted by the key only those row groups are read."""
    return df.where(F.col(key).startswith(prefix))


def write_lines(df: DataFrame, line: str, path: str) -> None:
    """One text line per row; refuses to overwrite."""
    df.select(line).write.mode("errorifexists").text(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Adds score rows to a folder of JSON lines."""
    scores.write.mode("append").json(path)


def write_roc(hits: DataFrame, path: str) -> None:
    """``correct`` and ``score``, tab-separated, best first; refuses to overwrite."""
    hits.select("correct", "score").orderBy(F.col("score").desc()).write.mode("errorifexists").option("sep", "\t").csv(path)


def xml_values(text: Column, path: str) -> Column:
    """The texts at an XPath of an XML column, an array."""
    return F.xpath(text, F.lit(path))
