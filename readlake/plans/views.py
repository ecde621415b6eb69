"""Views over the driver's tables: documents as reads, embeddings as scored evidence, order lines as votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.functions import vector as v
from readlake.session import importable

READ, PER_DOC = 150, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cut(rows: DataFrame, id_: str, letters: str, *keep: str) -> DataFrame:
    """Reads of READ letters from the whole text: all its letters of the alphabet, in order, cut on end."""
    bases = rows.select(id_, *keep, F.regexp_replace(F.upper("text"), f"[^{letters}]+", "").alias("bases"))
    starts = F.when(F.length("bases") > 0, F.sequence(F.lit(0), F.floor((F.length("bases") - 1) / READ).cast("int")))
    cut = bases.select("*", F.explode_outer(starts).alias("k")).where("k IS NOT NULL")
    return cut.select((F.col(id_) * PER_DOC + F.col("k")).alias("read_id"), F.substr("bases", F.col("k") * READ + 1, F.lit(READ)).alias("seq"), *keep)


def reads(spark: SparkSession, sf_dir: str, letters: str = "ACGT") -> DataFrame:
    """read_id, seq, tag, lang, cid (the first four bases)."""
    cut = _cut(table(spark, sf_dir, "documents"), "doc_id", letters, "source", "lang")
    return cut.select("read_id", "seq", F.col("source").alias("tag"), "lang", F.substring("seq", 1, 4).alias("cid"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gt_id, gt_seq: the benchmark items as reference reads."""
    return _cut(table(spark, sf_dir, "benchmark"), "item_id", "ACGT").select(F.col("read_id").alias("gt_id"), F.col("seq").alias("gt_seq"))


def scored(spark: SparkSession, sf_dir: str, factor: float = 20.0) -> DataFrame:
    """read_id, label, embedding, alpha, strength, u_epi, u_ale from embeddings: evidence is the softplus of block sums."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("read_id"), F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    alpha = F.array(*(v.softplus(factor * v.total(F.slice("embedding", 16 * b + 1, 16))) + 1 for b in range(4)))
    rows = rows.withColumn("alpha", alpha)
    return rows.withColumns({"strength": v.total(F.col("alpha")), "u_epi": v.epistemic(F.col("alpha")), "u_ale": v.aleatoric(F.col("alpha"))})


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cid"), F.col("l_partkey").alias("tag"))
