"""Synthetic reads: an insert-delete-substitute channel and a substitution channel, seeded by hashes, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _u(seed: int, *of: Column) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 40)) / float(1 << 40)


def _base(u: Column) -> Column:
    return F.substr(F.lit("ACGT"), F.floor(u * 4).cast("int") + 1, F.lit(1))


def references(spark: SparkSession, n: int, length: int = 150, seed: int = 1) -> DataFrame:
    """Cluster_ID (from 1), Ref_Seq."""
    base = lambda i: _base(_u(seed, F.col("Cluster_ID"), i))
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("Cluster_ID")).select("Cluster_ID", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), base), "").alias("Ref_Seq"))


def ids_channel(refs: DataFrame, copies: int = 100, spread: float = 0.4, p_insert: float = 0.0005, p_delete: float = 0.0005, p_substitute: float = 0.008, dropout: float = 0.0001, seed: int = 2) -> DataFrame:
    """Read_ID, Cluster_ID, Ref_Seq, seq: copies of each reference (plus or minus spread) through the channel; some clusters drop out."""
    depth = F.round(copies * (1 - spread + 2 * spread * _u(seed, F.col("Cluster_ID")))).cast("int")
    rows = refs.where(_u(seed + 1, F.col("Cluster_ID")) >= dropout).withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(depth, F.lit(1)))))

    def sent(x: Column, i: Column) -> Column:
        at = (F.col("Cluster_ID"), F.col("copy"), i)
        kept = F.when(_u(seed + 2, *at) < p_delete, "").when(_u(seed + 3, *at) < p_substitute, F.translate(x, "ACGT", "CGTA")).otherwise(x)
        return F.concat(F.when(_u(seed + 4, *at) < p_insert, _base(_u(seed + 5, *at))).otherwise(""), kept)

    seq = F.array_join(F.transform(F.filter(F.split("Ref_Seq", ""), lambda x: x != ""), sent), "")
    return rows.select((F.col("Cluster_ID").cast("long") * 1_000_000 + F.col("copy")).alias("Read_ID"), "Cluster_ID", "Ref_Seq", seq.alias("seq"))


def substitution_channel(refs: DataFrame, copies: int = 20, low: float = 0.01, high: float = 0.10, seed: int = 9) -> DataFrame:
    """read_id, label, seq: each copy with its own rate between low and high."""
    rows = refs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("rate", low + (high - low) * _u(seed, F.col("Cluster_ID"), F.col("copy")))
    sent = lambda x, i: F.when(_u(seed + 1, F.col("Cluster_ID"), F.col("copy"), i) < F.col("rate"), F.translate(x, "ACGT", "CGTA")).otherwise(x)
    seq = F.array_join(F.transform(F.filter(F.split("Ref_Seq", ""), lambda x: x != ""), sent), "")
    return rows.select((F.col("Cluster_ID").cast("long") * 1_000_000 + F.col("copy")).alias("read_id"), F.col("Cluster_ID").alias("label"), seq.alias("seq"))
