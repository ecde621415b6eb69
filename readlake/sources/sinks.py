"""Writers: Spark's own writers over the rows in the shapes that readers of the text formats expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.operators.metrics import report


def write_assignments(pairs: DataFrame, path: str) -> None:
    """A literal list for each pair, a line each, with no shuffle: readers take any number of lists."""
    pairs.select(F.concat(F.lit("[('"), F.col("read_id"), F.lit("', '"), F.col("cluster_id"), F.lit("')]")).alias("value")).write.text(path)


def write_assignment_list(pairs: DataFrame, path: str) -> None:
    """Pairs on one line, a line in each file, with no shuffle."""
    pairs.select(F.concat(F.lit("('"), F.col("read_id"), F.lit("', '"), F.col("cluster_id"), F.lit("')")).alias("value")).write.option("lineSep", ", ").text(path)


def write_metadata(meta: DataFrame, path: str) -> None:
    """read_id,cluster_id with a header, in order of read_id across the files."""
    meta.orderBy("read_id").write.csv(path, header=True)


def write_blocks(blocks: DataFrame, path: str, cluster: str = "cid") -> None:
    """A block is its reference, its reads, and a line of =, in order of cluster across the files. blocks: cluster, reference, reads."""
    lines = F.concat(F.array("reference"), F.col("reads"), F.array(F.lit("=" * 32)))
    blocks.repartitionByRange(cluster).sortWithinPartitions(cluster).select(F.array_join(lines, "\n").alias("value")).write.text(path)


def write_block_lines(members: DataFrame, path: str, cluster: str = "cid") -> None:
    """The same file from rows (cluster, reference, read_id, seq), sorted, so that no cluster is gathered into one value. A null seq is no read."""
    ends = members.groupBy(cluster).agg(F.min("reference").alias("reference")).select(
        cluster, F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("reference").alias("value")), F.struct(F.lit(2).alias("part"), F.lit("=" * 32).alias("value")))).alias("e")
    )
    rows = ends.select(cluster, "e.part", F.lit(None).cast(members.schema["read_id"].dataType).alias("read_id"), "e.value")
    rows = rows.unionByName(members.where("seq IS NOT NULL").select(cluster, F.lit(1).alias("part"), "read_id", F.col("seq").alias("value")))
    rows.repartitionByRange(cluster, "part", "read_id").sortWithinPartitions(cluster, "part", "read_id").select("value").write.text(path)


def write_report(row: DataFrame, path: str) -> None:
    """One row as text lines `name: number`."""
    report(row).coalesce(1).write.text(path)


def write_references(blocks: DataFrame, path: str, cluster: str = "cid") -> None:
    blocks.repartitionByRange(cluster).sortWithinPartitions(cluster).select(F.concat(F.lit(">"), F.col(cluster), F.lit("\n"), F.col("reference")).alias("value")).write.text(path)


def write_consensus(records: DataFrame, path: str) -> None:
    """FASTA in order of cluster id."""
    header = F.format_string(">cluster_%d_reads%d_highconf%d_strength%.3f", "cluster_id", "num_reads", "num_high_conf", "avg_strength")
    records.repartitionByRange("cluster_id").sortWithinPartitions("cluster_id").select(F.concat(header, F.lit("\n"), F.col("seq")).alias("value")).write.text(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """read_id and label as Parquet: a label's key is never its place in a file."""
    labels.select("read_id", F.coalesce("label", F.lit(-1)).alias("label")).write.parquet(path)


def write_label_lines(labels: DataFrame, path: str, size: int | None = None) -> None:
    """A line with a label for each read_id from 0 on, in order over the files; -1 for read_ids without one. size: lines in all, else up to the greatest read_id.

    Of labels that repeat a read_id the least is written. read_ids under 0 or from `size` on are an error."""
    spark = labels.sparkSession
    rows = labels.groupBy(F.col("read_id").cast("long").alias("id")).agg(F.min("label").alias("label"))
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    size = (0 if high is None else high + 1) if size is None else size
    if high is not None and (low < 0 or high >= size):
        raise ValueError(f"read_ids from {low} to {high} have no place in {size} lines")
    every = spark.range(size).join(rows, "id", "left")
    every.repartitionByRange("id").sortWithinPartitions("id").select(F.coalesce("label", F.lit(-1)).cast("string").alias("value")).write.text(path)


def write_round(tables: dict[str, DataFrame], root: str, number: int) -> None:
    """root/round=N/name for each table; a finished round has a marker table, so that a resumed run skips it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/round={number}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(number).alias("number")).write.mode("overwrite").parquet(f"{root}/round={number}/_done.parquet")


def last_round(spark, root: str) -> int:
    """The greatest finished round, 0 if there is none. Rounds are numbered, never told by clock."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/round=*/_done.parquet/_SUCCESS")
    found = path.getFileSystem(conf).globStatus(path) or []
    return max([0, *(int(str(f.getPath()).split("round=")[1].split("/")[0]) for f in found)])


def write_metrics(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.json(path)  # one row


def write_log(row: DataFrame, path: str, mode: str = "append") -> None:
    row.coalesce(1).write.mode(mode).csv(path, header=True)  # one row for each round


def write_reads(reads: DataFrame, path: str, lines_per_file: int = 5_000_000) -> None:
    """`id seq` lines, chunked into files."""
    reads.select(F.concat_ws(" ", "read_id", "seq").alias("value")).write.option("maxRecordsPerFile", lines_per_file).text(path)


def write_truth(clusters: DataFrame, path: str) -> None:
    clusters.select("Cluster_ID", "Ref_Seq").write.csv(path, sep="\t", header=True)
