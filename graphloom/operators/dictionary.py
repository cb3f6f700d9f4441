"""Dense ids for names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranking import rank_within


def sorted_dictionary(names: DataFrame, name: str) -> DataFrame:
    """``name``, ``id``: the distinct names in byte order, ids from 1 without gaps."""
    return rank_within(names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct(), [], ["name"], "id")


def first_seen_dictionary(occurrences: DataFrame, name: str, order: Column) -> DataFrame:
    """``name``, ``id``: the distinct names in the order of their first occurrence, ids from 1."""
    first = occurrences.select(F.col(name).alias("name"), order.alias("_o")).where("name IS NOT NULL").groupBy("name").agg(F.min("_o").alias("_o"))
    return rank_within(first, [], ["_o", "name"], "id").select("name", "id")


def link_names(links: DataFrame, dabs: DataFrame) -> tuple[DataFrame, Column]:
    """Occurrences of page names, disambiguation pages first, then sources and targets link by
    link, and the expression of their order."""
    first = dabs.select(F.col("title").alias("name"), F.lit(0).alias("_stage"), F.col("title").alias("_a"), F.lit("").alias("_b"), F.lit(0).alias("_c")).distinct()
    rest = links.select(F.explode(F.array(F.struct(F.col("src").alias("name"), F.lit(0).alias("_c")), F.struct(F.col("dst").alias("name"), F.lit(1).alias("_c")))).alias("_x"), "src", "dst")
    rest = rest.select("_x.name", F.lit(1).alias("_stage"), F.col("src").alias("_a"), F.col("dst").alias("_b"), "_x._c")
    return first.unionByName(rest), F.struct("_stage", "_a", "_b", "_c")


def encode(df: DataFrame, column: str, dictionary: DataFrame, into: str, keep_unknown: bool = False) -> DataFrame:
    """``df`` with the id of ``column`` as ``into``; unknown names are dropped or get null."""
    d = dictionary.select(F.col("name").alias("_name"), F.col("id").alias(into))
    return df.join(d, df[column] == d["_name"], "left" if keep_unknown else "inner").drop("_name")


def decode(df: DataFrame, column: str, dictionary: DataFrame, into: str) -> DataFrame:
    """``df`` with the name of the id in ``column`` as ``into``; unknown ids are dropped."""
    d = dictionary.select(F.col("id").alias("_id"), F.col("name").alias(into))
    return df.join(d, df[column] == d["_id"]).drop("_id")
