"""Readers of the text formats of reads, references, assignments, blocks, labels and truth. Every row carries an explicit id.

Text files have no order in Spark, so lines are numbered by file and block: lines of a block reach one task in order, are numbered
there, and then moved by the counts of the blocks before. Line numbers count all physical lines of a file from 1; records are told apart by
counts of marked lines, made in the same way, so that a file of any size is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readlake.functions import sequence as s


def lines(spark: SparkSession, path: str | list[str], mark: Column | None = None, across: bool = False) -> DataFrame:
    """path, line_no, value; with `mark`, a condition on value, also marks: how many lines up to this one meet it, and since: how many other lines
    with text stand after the last of these, this one included. Numbers begin anew in each file, or go on over the files in order of their paths (`across`).

    Large files split into blocks; lines are numbered and counted in each block and moved by the blocks before, so that no file is the work of one task.
    """
    text = F.rtrim(F.regexp_replace("value", "\r$", "")).alias("value")
    raw = spark.read.option("wholetext", "false").option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), text)
    raw = raw.withColumn("mark", F.lit(False) if mark is None else F.coalesce(mark, F.lit(False)))
    numbered = raw.mapInArrow(_in_block, "path string, block long, in_block long, marks_in_block long, since_in_block long, value string")
    sizes = numbered.groupBy("path", "block").agg(F.max("in_block").alias("n"), F.max("marks_in_block").alias("m"), F.max_by("since_in_block", "in_block").alias("s"))  # a row for each block
    order = ["path", "block"]
    whole = Window.partitionBy() if across else Window.partitionBy("path")
    over = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("path", "block", "m", "s", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"before_{c}") for c in "nm"))
    # what the blocks since the last one with a mark add up to
    run = (Window.partitionBy("run") if across else Window.partitionBy("path", "run")).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = before.withColumn("run", F.col("before_m") + F.col("m")).withColumn("upto", F.sum("s").over(run))
    before = before.withColumn("before_s", F.coalesce(F.lag("upto").over(whole.orderBy(*order)), F.lit(0))).select("path", "block", "before_n", "before_m", "before_s")
    found = numbered.join(before, ["path", "block"])
    since = F.col("since_in_block") + F.when(F.col("marks_in_block") == 0, F.col("before_s")).otherwise(0)
    marks = [] if mark is None else [(F.col("before_m") + F.col("marks_in_block")).alias("marks"), since.alias("since")]
    return found.select("path", (F.col("before_n") + F.col("in_block")).alias("line_no"), "value", *marks)


def _in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the lines of each block of a file from 1, and counts its marks and the lines since; a block's lines reach one task in order."""
    key, n, m, s = None, 0, 0, 0
    for batch in batches:
        out, marks, since = [], [], []
        for path, block, mark, value in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "mark", "value")), strict=True):
            n, m, s = (n, m, s) if (path, block) == key else (0, 0, 0)
            key, n, m = (path, block), n + 1, m + mark
            s = 0 if mark else s + (value != "")
            out.append(n)
            marks.append(m)
            since.append(s)
        counts = [pa.array(x, pa.int64()) for x in (out, marks, since)]
        yield pa.record_batch([batch.column("path"), batch.column("block"), *counts, batch.column("value")], ["path", "block", "in_block", "marks_in_block", "since_in_block", "value"])


def _parts(value: str | Column = "value") -> Column:
    return F.split(F.trim(value), r"\s+")


def read_indexed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """read_id, seq from lines `<id> <seq>` of a path, a glob, or several of them; lines with fewer than two fields go, the last line of an id wins."""
    rows = lines(spark, path).where(F.size(_parts()) >= 2).select(F.get(_parts(), F.lit(0)).alias("read_id"), F.element_at(_parts(), -1).alias("seq"), F.struct("path", "line_no").alias("at"))
    return rows.groupBy("read_id").agg(F.max_by("seq", "at").alias("seq"))


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """line_no, tag, seq: the first field is the true tag, the last the sequence; malformed lines count in line_no."""
    return lines(spark, path).where(F.size(_parts()) >= 2).select("line_no", F.get(_parts(), F.lit(0)).alias("tag"), F.element_at(_parts(), -1).alias("seq"))


def read_fasta(spark: SparkSession, path: str, last_line_only: bool = False) -> DataFrame:
    """name, seq: headers begin with >; wrapped sequences are joined, or only their last line is kept."""
    rows = lines(spark, path, F.col("value").startswith(">")).withColumnRenamed("marks", "record").where("value <> '' AND record > 0")
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("value").startswith(">"), F.struct("line_no", F.trim("value").alias("v"))))), lambda x: x["v"])
    rows = rows.groupBy("path", "record").agg(F.max(F.when(F.col("value").startswith(">"), F.substring("value", 2, 1 << 30))).alias("name"), body.alias("body"))
    seq = F.coalesce(F.try_element_at("body", F.lit(-1)), F.lit("")) if last_line_only else F.array_join("body", "")
    return rows.select(F.trim("name").alias("name"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of records of four lines, all of them."""
    rows = lines(spark, path).withColumn("record", F.expr("(line_no - 1) div 4")).groupBy("path", "record")
    at = lambda k: F.max(F.when((F.col("line_no") - 1) % 4 == k, F.trim("value")))
    return rows.agg(at(0).alias("name"), at(1).alias("seq")).where("name LIKE '@%'").select(F.substring("name", 2, 1 << 30).alias("name"), "seq")


def _first_lines(rows: DataFrame) -> DataFrame:
    """(path, first): the first line of each file that isn't blank. rows: lines() marked by that."""
    return rows.where("marks = 1 AND value <> ''").groupBy("path").agg(F.min("value").alias("first"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """tag, ref_seq from FASTA, or from bare alternating lines of tag and sequence: the first line that isn't blank tells. Blank lines don't count."""
    rows = lines(spark, path, F.col("value") != "")
    plain = _first_lines(rows).where("NOT first LIKE '>%'")
    bare = rows.where("value <> ''").join(plain, "path", "left_semi").withColumn("record", F.expr("(marks - 1) div 2")).groupBy("path", "record")
    at = lambda k: F.max(F.when((F.col("marks") - 1) % 2 == k, F.trim("value")))
    return read_fasta(spark, path).select(F.col("name").alias("tag"), F.col("seq").alias("ref_seq")).unionByName(bare.agg(at(0).alias("tag"), at(1).alias("ref_seq")).select("tag", "ref_seq"))


def read_consensus(spark: SparkSession, path: str, no_count: int = 1) -> DataFrame:
    """cluster_id, num_reads (no_count where the header names none), num_high_conf, avg_strength, seq from a consensus FASTA."""
    rows = read_fasta(spark, path).select(*(x.alias(k) for k, x in s.header_fields(F.col("name")).items()), "seq")
    return rows.withColumn("num_reads", F.coalesce("num_reads", F.lit(no_count)))


def read_bulk(spark: SparkSession, path: str, star: bool = False) -> DataFrame:
    """line_no, read_id, seq of lines `<id> <seq>` without an N anywhere in the line, and with `star` without a * too."""
    clean = ~F.col("value").contains("N") & (~F.col("value").contains("*") if star else F.lit(True))
    return lines(spark, path).where(clean & (F.size(_parts()) >= 2)).select("line_no", F.get(_parts(), F.lit(0)).alias("read_id"), F.element_at(_parts(), -1).alias("seq"))


def read_assignments(spark: SparkSession, path: str, drop_noise: bool = True) -> DataFrame:
    """read_id, cluster_id from literal lists of (follower, founder) pairs, any number to a line, or lines of two fields."""
    rows = lines(spark, path)
    pairs = rows.select(F.explode_outer(s.pairs_in(F.col("value"))).alias("p")).where("p IS NOT NULL").select(F.col("p.follower").alias("read_id"), F.col("p.founder").alias("cluster_id"))
    plain = rows.where(~F.col("value").contains("(") & (F.size(_parts()) == 2)).select(F.get(_parts(), F.lit(0)).alias("read_id"), F.get(_parts(), F.lit(1)).alias("cluster_id"))
    every = pairs.unionByName(plain)
    return every.where("cluster_id <> '-1'") if drop_noise else every


#: A pair up to its closing bracket.
PAIR_END = r"\('?([^',()\s]+)'?,\s*'?([^',()\s]+)'?\s*$"


def read_assignment_list(spark: SparkSession, path: str, drop_noise: bool = True) -> DataFrame:
    """read_id, cluster_id of lists of (follower, founder) pairs, however long their lines: text is cut at each closing bracket, so that
    many tasks read one line, each from the first bracket in its range on. For files of pairs; lines of two fields need read_assignments."""
    pairs = spark.read.option("lineSep", ")").text(path).select(*(F.regexp_extract("value", PAIR_END, k).alias(n) for k, n in ((1, "read_id"), (2, "cluster_id"))))
    pairs = pairs.where("read_id <> ''")
    return pairs.where("cluster_id <> '-1'") if drop_noise else pairs


def read_blocks(spark: SparkSession, path: str, separator: str = "====") -> DataFrame:
    """block_id, pos, seq, is_ref: a block's first line is its reference; a line of = ends it. Numbers begin at 0, blocks without lines count.

    The files of a path are one text, in order of their names: blocks go on over their ends, and so do numbers. No block is gathered anywhere.
    """
    ends = F.col("value").startswith(separator)
    rows = lines(spark, path, ends, across=True).where((F.col("value") != "") & ~ends)
    return rows.select(F.col("marks").alias("block_id"), (F.col("since") - 1).alias("pos"), F.trim("value").alias("seq"), (F.col("since") == 1).alias("is_ref"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """read_id (the line's number from 0, over all files in order of their names), label; -1 is noise."""
    return lines(spark, path, across=True).select((F.col("line_no") - 1).alias("read_id"), F.col("value").try_cast("int").alias("label")).where("label IS NOT NULL")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Cluster_ID, Ref_Seq from a TSV with a header; malformed rows go."""
    return spark.read.csv(path, sep="\t", header=True, schema="Cluster_ID int, Ref_Seq string", mode="DROPMALFORMED")


def read_truth_reads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="Read_ID long, Cluster_ID int, Ref_Seq string, Quality string", mode="DROPMALFORMED")


def read_centers(spark: SparkSession, path: str, longer_than: int = 20) -> DataFrame:
    """center_id, seq: FASTA with the id after the first _, or one sequence to a line numbered from 0."""
    rows = lines(spark, path).where("value <> ''")
    fasta = read_fasta(spark, path).select(F.split("name", "_")[1].try_cast("long").alias("center_id"), "seq")
    bare = rows.where(~F.col("value").startswith(">")).join(rows.where(F.col("value").startswith(">")).select("path").distinct(), "path", "left_anti")
    return fasta.unionByName(bare.where(F.length("value") > longer_than).select((F.col("line_no") - 1).alias("center_id"), F.trim("value").alias("seq")))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct read_id of FASTA, FASTQ or plain files; comments with # go. In a file that begins with @, ids are the first of every four lines."""
    rows = lines(spark, path, F.col("value") != "")
    rows = rows.where("value <> ''").join(_first_lines(rows), "path")
    fastq = F.col("first").startswith("@")
    header = F.when(fastq, (F.col("marks") - 1) % 4 == 0).otherwise(F.col("value").startswith(">"))
    plain = ~fastq & ~F.col("value").startswith("#") & (F.size(_parts()) >= 2)
    return rows.select(F.when(header, F.regexp_extract("value", r"^[>@](\S+)", 1)).when(plain, F.get(_parts(), F.lit(0))).alias("read_id")).where("read_id IS NOT NULL").distinct()


def read_training(spark: SparkSession, root: str, dataset: str, split: str) -> DataFrame:
    """dataset, split, block_id, reads, reference: blocks of reads.txt paired with the lines of reference.txt; empty blocks go. Both may be folders, whose files are one text."""
    ends = F.col("value").startswith("=")
    rows = lines(spark, f"{root}/{dataset}/{split}/reads.txt", ends, across=True).withColumnRenamed("marks", "block_id").where((F.col("value") != "") & ~ends)
    reads = rows.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]).alias("reads"))
    refs = lines(spark, f"{root}/{dataset}/{split}/reference.txt", across=True).select((F.col("line_no") - 1).alias("block_id"), F.col("value").alias("reference"))
    return reads.join(refs, "block_id").select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), "block_id", "reads", "reference")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of JSON objects, each in a file of its own, in which lines that begin with // are remarks. Values are text."""
    whole = spark.read.text(path, wholetext=True)
    plain = F.regexp_replace("value", r"(?m)^[ \t]*//.*$", "")
    return whole.select(F.explode(F.from_json(plain, "map<string,string>")).alias("key", "value"))
