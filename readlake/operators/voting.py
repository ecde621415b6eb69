"""Majority votes over assignments, references for clusters, blocks, and metadata. Ties go to the smallest value, always."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.session import keep


def vote(rows: DataFrame, cluster: str = "cid", tag: str = "tag", order: str | None = None) -> DataFrame:
    """(cluster, tag, n, total): the commonest tag of each cluster. Ties: least `order` (first seen) if given, else least tag.

    Two aggregations with map-side combine and no window: counts per (cluster, tag), then the best count per cluster.
    """
    seen = [F.min(order).alias("first")] if order else []
    counts = rows.groupBy(cluster, tag).agg(F.count("*").alias("n"), *seen)
    rank = F.struct((-F.col("n")).alias("minus_n"), *([F.col("first")] if order else []), F.col(tag).alias("tag"))
    best = counts.groupBy(cluster).agg(F.min(rank).alias("best"), F.sum("n").alias("total"))
    return best.select(cluster, F.col("best.tag").alias(tag), (-F.col("best.minus_n")).alias("n"), "total")


def attach_reference(votes: DataFrame, references: DataFrame, tag: str = "tag") -> DataFrame:
    """Clusters whose winning tag has a reference, with it."""
    return votes.join(references, tag)


def with_reference(rows: DataFrame, voted: DataFrame, cluster: str = "cid") -> DataFrame:
    """The rows whose cluster has a reference."""
    return rows.join(voted.select(cluster), cluster, "left_semi")


def join_assignments(reads: DataFrame, assignments: DataFrame, include_founders: bool = True) -> DataFrame:
    """Reads with their cluster: by id, never by position. Founders belong to their own cluster, unless that is not wanted."""
    pairs = assignments.select("read_id", "cluster_id")
    if include_founders:
        pairs = pairs.unionByName(assignments.select(F.col("cluster_id").alias("read_id"), "cluster_id").distinct()).distinct()
    return reads.join(pairs, "read_id")


def metadata(assignments: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """(read_id, cluster_id) as strings: follower to founder, founder to itself, any other read to -1."""
    pairs = assignments.select(F.col("read_id").cast("string"), F.col("cluster_id").cast("string"))
    founders = pairs.select(F.col("cluster_id").alias("read_id"), "cluster_id").distinct()
    known = pairs.unionByName(founders).groupBy("read_id").agg(F.min("cluster_id").alias("cluster_id"))
    if reads is None:
        return known
    return reads.select(F.col("read_id").cast("string")).distinct().join(known, "read_id", "left").select("read_id", F.coalesce("cluster_id", F.lit("-1")).alias("cluster_id"))


def metadata_coverage(meta: DataFrame) -> DataFrame:
    """n_reads, n_founders, n_followers, n_orphans, coverage."""
    orphan, founder = F.col("cluster_id") == "-1", F.col("cluster_id") == F.col("read_id")
    out = meta.agg(F.count("*").alias("n_reads"), F.count_if(founder).alias("n_founders"), F.count_if(~orphan & ~founder).alias("n_followers"), F.count_if(orphan).alias("n_orphans"))
    return out.withColumn("coverage", (F.col("n_founders") + F.col("n_followers")) / F.col("n_reads"))


def left_label(reads: DataFrame, truth: DataFrame, size: int = 80) -> DataFrame:
    """Reads with the tag of the truth that begins with the same `size` bases, -1 if there is none; the last line wins."""
    key = lambda s: F.substring(s, 1, size)
    known = truth.groupBy(key("seq").alias("key")).agg(F.max_by("tag", "read_id").alias("tag"))
    return reads.withColumn("key", key("seq")).join(known, "key", "left").drop("key").withColumn("tag", F.coalesce("tag", F.lit("-1")))


def block_numbers(lines: DataFrame, separator: Column, order: str, within: str) -> DataFrame:
    """The number of each line's block in its group, from 0: a separator begins the next one. Lines of a whole file are numbered by sources.text.lines, without a window over them."""
    over = Window.partitionBy(within).orderBy(order)
    return lines.withColumn("block_id", F.sum(separator.cast("long")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def block_edges(rows: DataFrame, block: str, order: str, within: str) -> DataFrame:
    """is_first and is_last of every row in its block, by comparing neighbours in its group."""
    over = Window.partitionBy(within).orderBy(order)
    return rows.withColumns({"is_first": ~F.col(block).eqNullSafe(F.lag(block).over(over)), "is_last": ~F.col(block).eqNullSafe(F.lead(block).over(over))})


def to_blocks(rows: DataFrame, voted: DataFrame, cluster: str = "cid") -> DataFrame:
    """(cluster, reference, reads): members in order of read_id, of clusters with a reference."""
    members = rows.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("read_id", "seq"))), lambda x: x["seq"]).alias("reads"))
    return members.join(voted.select(cluster, F.col("ref_seq").alias("reference")), cluster)


def founder_blocks(reads: DataFrame, assignments: DataFrame) -> DataFrame:
    """(cid, reference, read_id, seq): the members of each founder that is itself among the reads; the founder's own read is the reference."""
    followers = assignments.select("read_id", F.col("cluster_id").alias("cid")).where("read_id <> cid")
    found = reads.select(F.col("read_id").alias("cid"), F.col("seq").alias("reference")).join(followers.select("cid").distinct(), "cid", "left_semi")
    members = followers.join(reads.select("read_id", "seq"), "read_id")
    return found.join(members, "cid", "left").select("cid", "reference", "read_id", "seq")


def noise_share(reads: DataFrame, assignments: DataFrame) -> DataFrame:
    """n_reads, n_noise, noise_share: reads that no assignment names as a member."""
    known = assignments.select("read_id").distinct().withColumn("known", F.lit(True))
    out = reads.select("read_id").join(known, "read_id", "left").agg(F.count("*").alias("n_reads"), F.count_if(F.col("known").isNull()).alias("n_noise"))
    return out.withColumn("noise_share", F.col("n_noise") / F.col("n_reads"))


def kept_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """(read_id, label): the new labels if there are as many as reads, else the old ones."""
    counts = old.agg(F.count("*").alias("n_old")).crossJoin(new.agg(F.count("*").alias("n_new")))  # one row each
    both = old.select("read_id", F.col("label").alias("old")).join(new.select("read_id", F.col("label").alias("new")), "read_id", "left")
    return both.crossJoin(F.broadcast(counts)).select("read_id", F.when(F.col("n_old") == F.col("n_new"), F.coalesce("new", "old")).otherwise(F.col("old")).alias("label"))


def numbered(rows: DataFrame, order: str, chunk: int = 5_000_000) -> DataFrame:
    """line_no (1-based, by `order`) and chunk_id. Ranges of `order` are numbered in parallel and moved by the counts before them.

    The ranges are kept first: they come from a sample, and both uses must see the same ones.
    """
    dealt = keep(rows.repartitionByRange(order).withColumn("range_id", F.spark_partition_id()))
    over = Window.partitionBy("range_id").orderBy(order)
    before = dealt.groupBy("range_id").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    out = dealt.withColumn("in_range", F.row_number().over(over)).join(F.broadcast(before), "range_id")  # one row for each partition
    return out.withColumn("line_no", F.col("in_range") + F.col("before")).withColumn("chunk_id", F.expr(f"(line_no - 1) div {chunk}")).drop("range_id", "in_range", "before")


def keep_largest(records: DataFrame, seq: str = "seq", weight: str = "num_reads", order: str = "cluster_id") -> DataFrame:
    """One record for each distinct sequence: the one with most reads, then the smallest id."""
    rest = [c for c in records.columns if c != seq]
    rank = F.struct((-F.col(weight)).alias("w"), F.col(order).alias("o"))
    return records.groupBy(seq).agg(F.min_by(F.struct(*rest), rank).alias("r")).select(*(seq if c == seq else F.col(f"r.{c}").alias(c) for c in records.columns))


def dedup_statistics(records: DataFrame, seq: str = "seq") -> DataFrame:
    """n_before, n_after, n_merged, percent_merged."""
    out = records.agg(F.count("*").alias("n_before"), F.count_distinct(seq).alias("n_after"))
    return out.withColumn("n_merged", F.col("n_before") - F.col("n_after")).withColumn("percent_merged", 100 * F.col("n_merged") / F.col("n_before"))
