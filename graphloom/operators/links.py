"""The link graph: redirects, adjacency, label counts and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normal_label
from graphloom.operators.ranking import rank_within
from graphloom.session import cut

#: Neighbours in one row of an adjacency list.
CHUNK = 1000


def one_target(redirects: DataFrame) -> DataFrame:
    """``src``, ``dst``: repeated redirects once; of several targets the first in byte order."""
    return redirects.where(F.col("src").isNotNull()).groupBy("src").agg(F.min("dst").alias("dst"))


def resolve_redirects(links: DataFrame, redirects: DataFrame, hops: int = 1) -> DataFrame:
    """``links`` with ``dst`` replaced where it redirects, and ``fixed``, whether it was.

    A left join on ``dst``: adaptive execution broadcasts a small redirect table and
    splits the partitions of hot targets otherwise. Chains are followed ``hops``
    times. Null targets stay null.
    """
    r = one_target(redirects).select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    out = links.withColumn("fixed", F.lit(False))
    cols = out.columns
    for _ in range(hops):
        out = out.join(r, out["dst"] == r["_from"], "left").withColumn("fixed", F.col("fixed") | F.col("_to").isNotNull()).withColumn("dst", F.coalesce("_to", "dst")).select(*cols)
    return out


def regroup(links: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``labels``: one row per pair of pages with the labels of all its links,
    repeated ones kept, in sorted order."""
    return links.groupBy("src", "dst").agg(F.array_sort(F.flatten(F.collect_list(F.coalesce("labels", F.array().cast("array<string>"))))).alias("labels"))


def exploded_labels(links: DataFrame, *keep: str, tokenizer: str = "standard") -> DataFrame:
    """``keep`` and ``text``: a row per label with a token, normalised."""
    return links.select(*keep, F.explode("labels").alias("_label")).select(*keep, normal_label(F.col("_label"), tokenizer).alias("text")).where(F.col("text").isNotNull())


def label_index(labels: DataFrame) -> DataFrame:
    """``text``, ``dst``, ``n``: how often each label leads to each target."""
    return labels.groupBy("text", "dst").agg(F.count("*").alias("n"))


def label_shares(index: DataFrame) -> DataFrame:
    """Adds ``share`` of the label's occurrences; totals are summed before they are joined,
    so no label's targets are gathered."""
    totals = index.groupBy(F.col("text").alias("_t")).agg(F.sum("n").alias("_all"))
    return index.join(totals, index["text"] == totals["_t"]).select("text", "dst", "n", (F.col("n") / F.greatest("_all", F.lit(1))).alias("share"))


def best_targets(shares: DataFrame) -> DataFrame:
    """The target with the greatest share of each label, on a tie the first in byte order."""
    best = shares.groupBy("text").agg(F.min(F.struct((-F.col("n")).alias("_o"), "dst", "n", "share")).alias("_b"))
    return best.select("text", "_b.dst", "_b.n", "_b.share")


def ordered_targets(index: DataFrame) -> DataFrame:
    """``text``, ``pos``, ``dst``, ``n``: the label's targets in byte order, numbered from 1."""
    return rank_within(index, ["text"], ["dst"], "pos").select("text", "pos", "dst", "n")


def in_link_counts(links: DataFrame, explode: bool = False) -> DataFrame:
    """``dst``, ``label``, ``is_total``, ``n``: links per target and label list, and per target.

    The label is the tab-joined list of a link, or with ``explode`` each of its
    labels. Totals have an empty label and ``is_total`` true.
    """
    label = F.explode("labels") if explode else F.array_join(F.coalesce("labels", F.array().cast("array<string>")), "\t")
    each = links.select("dst", label.alias("label")).groupBy("dst", "label").agg(F.count("*").alias("n"))
    every = links.groupBy("dst").agg(F.count("*").alias("n"))
    return each.select("dst", "label", F.lit(False).alias("is_total"), "n").unionByName(every.select("dst", F.lit("").alias("label"), F.lit(True).alias("is_total"), "n"))


def adjacency(links: DataFrame, node: str = "src", neighbour: str = "dst", chunk: int = CHUNK) -> DataFrame:
    """``node``, ``part``, ``neighbours``: the distinct neighbours in byte order, ``chunk`` a row.

    A node with few neighbours has one row, with ``part`` 0; a hub's list goes on in
    further rows, so that no row and no task holds all of it.
    """
    edges = links.select(F.col(node).alias("node"), F.col(neighbour).alias("_n")).where("node IS NOT NULL AND _n IS NOT NULL").distinct()
    ranked = rank_within(edges, ["node"], ["_n"]).withColumn("part", F.floor((F.col("rank") - 1) / chunk).cast("bigint"))
    return ranked.groupBy("node", "part").agg(F.array_sort(F.collect_list("_n")).alias("neighbours"))


def degrees(links: DataFrame, node: str, neighbour: str) -> DataFrame:
    """``node``, ``degree``: the number of distinct neighbours."""
    edges = links.select(F.col(node).alias("node"), F.col(neighbour).alias("_n")).where("node IS NOT NULL AND _n IS NOT NULL").distinct()
    return edges.groupBy("node").agg(F.count("*").alias("degree"))


def histogram(df: DataFrame, value: Column) -> DataFrame:
    """``n``, ``freq``: how many rows have each value."""
    return df.groupBy(value.cast("bigint").alias("n")).agg(F.count("*").alias("freq"))


def label_sets(links: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``labels``: the distinct labels of each pair of pages, sorted."""
    rows = links.select("src", "dst", F.explode("labels").alias("label")).distinct()
    return rows.groupBy("src", "dst").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def candidates(links: DataFrame, dabs: DataFrame) -> DataFrame:
    """``dab``, ``candidate``: the pages that each disambiguation page links to."""
    titles = dabs.select(F.col("title").alias("dab")).distinct()
    return links.join(titles, links["src"] == titles["dab"]).where("dst IS NOT NULL").select("dab", F.col("dst").alias("candidate")).distinct()


def candidate_counts(cands: DataFrame, links: DataFrame) -> DataFrame:
    """``dab``, ``candidate``, ``n``: the in-links of each candidate, 0 where it has none."""
    n = links.groupBy(F.col("dst").alias("_d")).agg(F.count("*").alias("_n"))
    return cands.join(n, cands["candidate"] == n["_d"], "left").select("dab", "candidate", F.coalesce("_n", F.lit(0)).alias("n"))


def split_ambiguous(links: DataFrame, dabs: DataFrame) -> DataFrame:
    """``links`` with ``is_amb``, whether the target is a disambiguation page."""
    titles = dabs.select(F.col("title").alias("_dab")).distinct()
    return links.join(titles, links["dst"] == titles["_dab"], "left").withColumn("is_amb", F.col("_dab").isNotNull()).drop("_dab")


def neighbour_features(edges: DataFrame, dabs: DataFrame, seed: int = 0) -> DataFrame:
    """``dab``, ``src``, ``picked``, ``feature``: for each page that links to an ambiguous page one of its
    other targets, drawn by hash, and the pages that link to that one."""
    e = cut(edges.select("src", "dst").distinct())
    titles = dabs.select(F.col("title").alias("dab")).distinct()
    sources = e.join(titles, e["dst"] == titles["dab"]).select("dab", "src")
    others = sources.join(e, "src").where("dst <> dab")
    first = others.groupBy("dab", "src").agg(F.min(F.struct(F.md5(F.concat_ws("\u0001", F.lit(str(seed)), "src", "dst")).alias("h"), "dst")).alias("_p")).select("dab", "src", F.col("_p.dst").alias("picked"))
    return first.join(e.select(F.col("dst").alias("picked"), F.col("src").alias("feature")), "picked").select("dab", "src", "picked", "feature")
