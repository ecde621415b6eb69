"""Votes as a stream: counts per (cluster, tag) grow by micro-batch; the winner is read from the last state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.session import shared_root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the one the cluster shares."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def vote_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("cid", "tag").agg(F.count("*").alias("n"))


def winners(counts: DataFrame) -> DataFrame:
    """As voting.vote, from counts."""
    best = counts.groupBy("cid").agg(F.min(F.struct((-F.col("n")).alias("m"), "tag")).alias("b"), F.sum("n").alias("total"))
    return best.select("cid", F.col("b.tag").alias("tag"), (-F.col("b.m")).alias("n"), "total")


def streamed_vote(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """Reads lineitem as a stream of files until all are read, and votes. Each batch's changed counts are kept as Parquet with its
    number, so a restarted batch overwrites its own part, and the last batch of a key holds its count."""
    path = f"{sf_dir}/lineitem.parquet"
    schema = spark.read.parquet(path).schema
    folder = shared_folder(spark, "vote")
    # a stream reads folders: of the files in the table's own folder, those with its name
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}*").select(F.col("l_suppkey").alias("cid"), F.col("l_partkey").alias("tag"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    run = vote_counts(rows).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    kept = spark.read.parquet(f"{folder}/counts")
    return winners(kept.groupBy("cid", "tag").agg(F.max_by("n", "batch").alias("n")))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events per window and type, on event time, with a watermark. An extension over the reference's batch world."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
