"""A training-corpus pipeline over the table documents.

Stages, in order: quality classifier (rejected documents go), line dedup, near dedup (the smallest doc_id of each group stays),
benchmark decontamination (documents that hold an item go), mixing of sources to target weights. Each stage takes
(spark, docs, sf_dir); all but the last return the columns of documents, the last one doc_id, size, source_size, target, taken and
the output shards of each document that is left.

Defined results: an empty table passes through all stages; null texts are scored as empty ones, and where they stay they have size 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import common, decontaminate, line_dedup, mixing, near_dedup, quality_classifier


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.learn(docs, common.table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text that is left."""
    found = line_dedup.keep_lines(docs)
    n_chars = F.when(F.col("dedup_lines.n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Linked from similarity 0.80 on, not from op2's 0.85; ten groups of keys keep op2's chance of a miss at that bound."""
    return near_dedup.keep_first(docs, percent=80, groups=10)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = mixing.mix(docs)
    return found.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("line dedup", drop_shared_lines),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("source mixing", mix_sources),
]

#: Compression scores and hashed permutations have no form in SQL; tests hold the pipeline against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written to the shared folder as Parquet and read again. Only the last one's files stay."""
    common.use_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return docs
