"""Link tables that grow while they are read: Structured Streaming over Parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import canonical_target
from graphloom.session import scratch_dir


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """New files of a table as a stream; the schema is that of the files that are there."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    one = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if one else reader.parquet(f"{folder}/{name}.parquet")


def windowed_targets(links: DataFrame, width: str = "30 days", late: str = "60 days") -> DataFrame:
    """``begin``, ``dst``, ``n``: links per canonical target and window of ``seen_at``.

    A link later than ``late`` behind the newest one seen is not counted any more, so
    the state that is kept is that of the windows still open. A link that comes in
    twice within that time counts once.
    """
    at = F.col("seen_at").cast("timestamp")
    once = links.select("link_id", canonical_target(F.col("dst")).alias("dst"), at.alias("seen_at")).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["link_id"])
    return once.groupBy(F.window("seen_at", width).alias("w"), "dst").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "dst", "n")


def run_available(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs the stream over what is there and gives the latest row of each key.

    Each batch is written once under its number, so a batch that is repeated after a
    failure replaces itself.
    """
    spark = stream.sparkSession
    path = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/part={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out/*").drop("part")
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    latest = rows.groupBy(*keys).agg(F.max(F.struct("_batch", *values)).alias("_l"))
    return latest.select(*keys, *[F.col(f"_l.{v}").alias(v) for v in values])
