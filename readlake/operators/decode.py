"""Consensus of a cluster from the evidence of its reads: rows (read_id, label, strength, high_conf, pos, base, alpha)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions.sequence import identity


def pseudo_counts(reads: DataFrame, extra: float = 1.0) -> DataFrame:
    """Evidence without a model: each base of a read counts one for itself, and `extra` for each of A, C, G, T. Keeps the read's columns."""
    at = reads.select("*", F.posexplode(F.split("seq", "")).alias("pos", "seen"))
    bases = F.explode(F.array(*map(F.lit, "ACGT")))
    return at.where("seen <> ''").withColumn("base", bases).withColumn("alpha", F.lit(extra) + (F.col("base") == F.col("seen")).cast("double")).drop("seen")


def eligible(reads: DataFrame) -> DataFrame:
    """(label, num_reads, num_high_conf, avg_strength) of clusters with two reads or more, at least one of high confidence."""
    counts = reads.where("label IS NOT NULL AND label >= 0").groupBy("label").agg(F.count("*").alias("num_reads"), F.count_if("high_conf").alias("num_high_conf"), F.avg("strength").alias("avg_strength"))
    return counts.where("num_reads >= 2 AND num_high_conf >= 1")


def read_weights(reads: DataFrame) -> DataFrame:
    """(read_id, label, weight): high-confidence reads alike if there are two; else all, 2 or 0.5 times the softmax of strength."""
    known = reads.select("read_id", "label", "strength", "high_conf").join(eligible(reads).select("label", "num_high_conf"), "label")
    # the greatest strength and the sum of exponentials come by aggregation, so that a large cluster never sits in one window
    top = known.groupBy("label").agg(F.max("strength").alias("top"))
    known = known.join(top, "label").withColumn("e", F.when(F.col("high_conf"), 2.0).otherwise(0.5) * F.exp(F.col("strength") - F.col("top")))
    sums = known.groupBy("label").agg(F.sum("e").alias("sum_e"))
    weight = F.when(F.col("num_high_conf") >= 2, F.when(F.col("high_conf"), 1.0 / F.col("num_high_conf")).otherwise(0.0)).otherwise(F.col("e") / F.col("sum_e"))
    return known.join(sums, "label").select("read_id", "label", weight.alias("weight")).where("weight > 0")


def softmax(rows: DataFrame, over: str, x: str, out: str = "softmax") -> DataFrame:
    """exp(x - max) / sum in each group. Maxima and sums come by aggregation, so that a large group never sits in one window."""
    top, total = (n if n not in rows.columns else f"_{n}" for n in ("_top", "_total"))
    tops = rows.groupBy(F.col(over).alias("_over")).agg(F.max(x).alias(top))
    rows_top = rows.join(tops, F.col(over).eqNullSafe(F.col("_over"))).drop("_over")
    e = F.exp(F.col(x) - F.col(top))
    sums = rows_top.groupBy(F.col(over).alias("_over")).agg(F.sum(e).alias(total))
    return rows_top.join(sums, F.col(over).eqNullSafe(F.col("_over"))).withColumn(out, e / F.col(total)).drop("_over", top, total)


def fused(evidence: DataFrame, weights: DataFrame) -> DataFrame:
    """(label, pos, base, alpha): the weighted evidence of each base at each place."""
    joined = evidence.select("read_id", "pos", "base", "alpha").join(weights, "read_id")
    return joined.groupBy("label", "pos", "base").agg(F.sum(F.col("alpha") * F.col("weight")).alias("alpha"))


def fused_counts(reads: DataFrame, weights: DataFrame, extra: float = 1.0) -> DataFrame:
    """What fused() gives for pseudo_counts(), with a row for each place of a read and not four."""
    # reads meet their weights whole; places are summed up where they are made
    heard = reads.select("read_id", "seq").join(weights, "read_id")
    at = heard.select("label", "weight", F.posexplode(F.split("seq", "")).alias("pos", "seen")).where("seen <> ''")
    sums = at.groupBy("label", "pos").agg(F.sum("weight").alias("w"), *(F.sum(F.when(F.col("seen") == b, F.col("weight")).otherwise(0.0)).alias(b) for b in "ACGT"))
    bases = F.explode(F.array(*(F.struct(F.lit(b).alias("base"), (extra * F.col("w") + F.col(b)).alias("alpha")) for b in "ACGT")))
    return sums.select("label", "pos", bases.alias("b")).select("label", "pos", "b.base", "b.alpha")


def consensus(reads: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(cluster_id, num_reads, num_high_conf, avg_strength, seq): the base with most evidence at each place, ties in the order A C G T.

    Without evidence, that of pseudo_counts().
    """
    weights = read_weights(reads)
    best = (fused_counts(reads, weights) if evidence is None else fused(evidence, weights)).groupBy("label", "pos").agg(F.min(F.struct((-F.round("alpha", 9)).alias("m"), "base")).alias("b"))
    seq = best.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("b.base").alias("base")))), lambda x: x["base"]), "").alias("seq"))
    return eligible(reads).join(seq, "label").select(F.col("label").alias("cluster_id"), "num_reads", "num_high_conf", "avg_strength", "seq")


def quality(records: DataFrame, truth: DataFrame) -> DataFrame:
    """n_clusters, avg_reads, avg_strength, avg_hc_ratio, and matched bases over longer lengths against truth (cluster_id, ref_seq)."""
    both = records.join(truth, "cluster_id", "left")
    longer = F.greatest(F.length("seq"), F.length("ref_seq"))
    matched = F.sum(F.when(F.col("ref_seq").isNotNull(), F.round(identity(F.col("seq"), F.col("ref_seq")) * longer)))
    return both.agg(
        F.count("*").alias("n_clusters"), F.avg("num_reads").alias("avg_reads"), F.avg("avg_strength").alias("avg_strength"),
        F.avg(F.col("num_high_conf") / F.col("num_reads")).alias("avg_hc_ratio"), (matched / F.sum(F.when(F.col("ref_seq").isNotNull(), longer))).alias("base_accuracy"),
    )
