"""More operators as queries beside their SQL: file formats written and read back, founder blocks, cleaning, summaries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.functions import sequence as s
from readlake.functions import vector as v
from readlake.operators import align, batches, cluster, decode, federated, match, metrics, voting
from readlake.plans import views
from readlake.plans.catalogue import _CONS, _FOUND, PG, G, R, RN, TABLE, E, _assignments, _IDENT, _labelled_reads, _lgamma, _pred, _psi, _sum, query, r6, rounded
from readlake.session import keep, shared_root
from readlake.sources import sinks, text

# ---------------------------------------------------------------- files written in each format, and read again


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, d: str, name: str, line: Callable[[DataFrame], DataFrame]) -> str:
    """A folder of text files with the column value of these rows."""
    path = _folder(spark, name)
    line(views.reads(spark, d)).select("value").write.text(path)
    return path


@query(R + "\nSELECT read_id::VARCHAR AS read_id, seq FROM r")
def file_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Lines `id sequence`, some malformed, some ids twice: the later line wins."""
    rows = lambda r: r.select(F.explode(F.array(F.concat_ws(" ", "read_id", F.lit("AC")), F.lit("malformed"), F.concat_ws(" \t", "read_id", "seq"))).alias("value"))
    return text.read_indexed(spark, _written(spark, d, "indexed", rows))


@query(R + "\nSELECT tag, seq, count(*) AS n FROM r GROUP BY 1, 2")
def file_tagged(spark: SparkSession, d: str) -> DataFrame:
    path = _written(spark, d, "tagged", lambda r: r.select(F.concat_ws(" ", "tag", F.lit("x"), "seq").alias("value")))
    return text.read_tagged(spark, path).groupBy("tag", "seq").agg(F.count("*").alias("n"))


@query(RN + "\nSELECT read_id::VARCHAR AS read_id, seq FROM rn WHERE NOT contains(seq, 'N')")
def file_bulk(spark: SparkSession, d: str) -> DataFrame:
    """Lines with an N anywhere go."""
    path = _folder(spark, "bulk")
    views.reads(spark, d, "ACGTN").select(F.concat_ws(" ", "read_id", "seq").alias("value")).write.text(path)
    return text.read_bulk(spark, path).select("read_id", "seq")


def _wrapped() -> Column:
    return F.concat(F.lit(">r"), F.col("read_id"), F.lit("\n"), F.substr("seq", F.lit(1), F.lit(60)), F.lit("\n"), F.substr("seq", F.lit(61)))


@query(R + "\nSELECT 'r' || read_id AS name, seq FROM r")
def file_fasta(spark: SparkSession, d: str) -> DataFrame:
    """Sequences wrapped at 60 bases, with empty lines between."""
    return text.read_fasta(spark, _written(spark, d, "fasta", lambda r: r.select(F.concat(_wrapped(), F.lit("\n")).alias("value"))))


@query(R + "\nSELECT 'r' || read_id AS name, CASE WHEN length(seq) > 60 THEN substr(seq, 61) ELSE '' END AS seq FROM r WHERE length(seq) > 60")
def file_fasta_last_line(spark: SparkSession, d: str) -> DataFrame:
    """Only the last line of each wrapped sequence."""
    rows = lambda r: r.where(F.length("seq") > 60).select(_wrapped().alias("value"))
    return text.read_fasta(spark, _written(spark, d, "fasta", rows), last_line_only=True)


def _fastq() -> Column:
    return F.concat(F.lit("@r"), F.col("read_id"), F.lit("\n"), F.col("seq"), F.lit("\n+\n@"), F.substr(F.repeat(F.lit("I"), 150), F.lit(1), F.length("seq") - 1))


@query(R + "\nSELECT 'r' || read_id AS name, seq FROM r")
def file_fastq(spark: SparkSession, d: str) -> DataFrame:
    """Quality lines begin with @."""
    return text.read_fastq(spark, _written(spark, d, "fastq", lambda r: r.select(_fastq().alias("value"))))


@query(R + "\nSELECT 'r' || read_id AS read_id FROM r")
def file_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of FASTQ files whose quality lines begin with @."""
    return text.read_ids(spark, _written(spark, d, "ids", lambda r: r.select(_fastq().alias("value"))))


@query(R + "\nSELECT read_id::VARCHAR AS tag, seq AS ref_seq FROM r")
def file_references(spark: SparkSession, d: str) -> DataFrame:
    """Bare lines of tag and sequence with blank lines first, between and inside."""
    rows = lambda r: r.select(F.concat(F.lit("\n"), F.col("read_id"), F.lit("\n \n"), F.col("seq"), F.lit("\n")).alias("value"))
    return text.read_references(spark, _written(spark, d, "references", rows))


@query(_FOUND + "\nSELECT read_id::VARCHAR AS read_id, founder::VARCHAR AS cluster_id FROM f WHERE read_id <> founder")
def file_assignments(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "assignments")
    sinks.write_assignments(_assignments(views.reads(spark, d)), path)
    return text.read_assignments(spark, path)


@query(_FOUND + "\nSELECT read_id::VARCHAR AS read_id, founder::VARCHAR AS cluster_id FROM f WHERE read_id <> founder")
def file_assignment_list(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that stand on one line, read by many tasks."""
    path = _folder(spark, "list")
    sinks.write_assignment_list(_assignments(views.reads(spark, d)), path)
    return text.read_assignment_list(spark, path)


@query("SELECT i AS read_id, coalesce(min(label), -1)::INT AS label FROM (SELECT unnest(range(0, (SELECT max(vec_id) + 1 FROM embeddings WHERE vec_id % 7 <> 3))) AS i) LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 7 <> 3) ON vec_id = i GROUP BY 1")
def file_label_lines(spark: SparkSession, d: str) -> DataFrame:
    """Labels as lines: every seventh read has none, its line is -1."""
    path, rows = _folder(spark, "label_lines"), views.table(spark, d, "embeddings")
    sinks.write_label_lines(rows.select(F.col("vec_id").alias("read_id"), F.when(F.col("vec_id") % 7 != 3, F.col("label")).alias("label")).where("label IS NOT NULL"), path)
    return text.read_labels(spark, path)


@query(_CONS + "\nSELECT label AS cluster_id, num_reads::INT AS num_reads, num_high_conf::INT AS num_high_conf, round(avg_strength, 3)::DOUBLE AS avg_strength, seq FROM el JOIN co USING (label)")
def file_consensus(spark: SparkSession, d: str) -> DataFrame:
    path, rows = _folder(spark, "consensus"), keep(_labelled_reads(spark, d))
    sinks.write_consensus(decode.consensus(rows), path)
    return text.read_consensus(spark, path)


@query("SELECT vec_id::BIGINT AS read_id, label::INT AS label FROM embeddings")
def file_labels(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "labels")
    sinks.write_labels(views.table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("read_id"), F.col("label").cast("int").alias("label")), path)
    return spark.read.parquet(path)


@query("SELECT p_partkey::INT AS Cluster_ID, p_name AS Ref_Seq FROM part")
def file_truth(spark: SparkSession, d: str) -> DataFrame:
    """A table of clusters as TSV, with rows whose id is no number."""
    path = _folder(spark, "truth")
    good = views.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("Cluster_ID"), F.col("p_name").alias("Ref_Seq"))
    sinks.write_truth(good.unionByName(good.limit(3).withColumn("Cluster_ID", F.lit("none"))), path)
    return text.read_truth(spark, path)


@query("SELECT p_partkey::BIGINT AS Read_ID, p_size::INT AS Cluster_ID, p_name AS Ref_Seq, p_type AS Quality FROM part")
def file_truth_reads(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "truth_reads")
    views.table(spark, d, "part").select(F.col("p_partkey").alias("Read_ID"), F.col("p_size").alias("Cluster_ID"), F.col("p_name").alias("Ref_Seq"), F.col("p_type").alias("Quality")).write.csv(path, sep="\t", header=True)
    return text.read_truth_reads(spark, path)


@query(R + "\nSELECT read_id AS center_id, seq FROM r")
def file_centers(spark: SparkSession, d: str) -> DataFrame:
    return text.read_centers(spark, _written(spark, d, "centers", lambda r: r.select(F.concat(F.lit(">center_"), F.col("read_id"), F.lit("\n"), F.col("seq")).alias("value"))))


@query(R + "\nSELECT read_id::VARCHAR AS read_id, seq FROM r")
def file_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Reads in files of at most 500 lines."""
    path = _folder(spark, "chunks")
    sinks.write_reads(views.reads(spark, d), path, 500)
    return text.read_indexed(spark, path)


@query(
    _FOUND
    + """,
b AS (SELECT f.founder AS cid, y.seq AS reference, f.read_id, x.seq FROM f JOIN r x USING (read_id) JOIN r y ON y.read_id = f.founder WHERE f.read_id <> f.founder)
SELECT 'I' AS dataset, 'train' AS split, dense_rank() OVER (ORDER BY cid) - 1 AS block_id, string_agg(seq, ',' ORDER BY read_id) AS reads, min(reference) AS reference FROM b GROUP BY cid"""
)
def file_training(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of reads and the lines of their references, in files whose ends cut blocks, paired by their numbers."""
    root, blocks = _folder(spark, "training"), keep(_founder_blocks(spark, d).where("seq IS NOT NULL"))
    sinks.write_block_lines(blocks.withColumn("reference", F.lit(None).cast("string")), f"{root}/I/train/reads.txt")
    blocks.groupBy("cid").agg(F.min("reference").alias("reference")).repartitionByRange("cid").sortWithinPartitions("cid").select(F.col("reference").alias("value")).write.text(f"{root}/I/train/reference.txt")
    return text.read_training(spark, root, "I", "train").withColumn("reads", F.array_join("reads", ","))


@query(_FOUND + "\nSELECT row_number() OVER (ORDER BY read_id::VARCHAR) AS place, read_id::VARCHAR AS read_id, founder::VARCHAR AS cluster_id FROM f WHERE read_id <> founder")
def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata in order of the ids as text over all files, each of which has a header."""
    path = _folder(spark, "metadata")
    sinks.write_metadata(_assignments(views.reads(spark, d)).select(*(F.col(n).cast("string").alias(n) for n in ("read_id", "cluster_id"))), path)
    rows = text.lines(spark, path, F.col("value").startswith("read_id"), across=True).where(~F.col("value").startswith("read_id"))
    part = F.split("value", ",")
    return rows.select((F.col("line_no") - F.col("marks")).alias("place"), part[0].alias("read_id"), part[1].alias("cluster_id"))


@query(
    _CONS
    + """,
d AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY num_reads DESC, label) AS k FROM el JOIN co USING (label))
SELECT row_number() OVER (ORDER BY label) AS place, label AS cluster_id, num_reads::INT AS num_reads, seq FROM d WHERE k = 1"""
)
def file_distinct_consensus(spark: SparkSession, d: str) -> DataFrame:
    """One record for each distinct sequence, written in order of ids: the place of each header in the files."""
    path = _folder(spark, "distinct")
    sinks.write_consensus(voting.keep_largest(decode.consensus(keep(_labelled_reads(spark, d)))), path)
    headers = text.lines(spark, path, F.col("value").startswith(">"), across=True).where(F.col("value").startswith(">"))
    places = headers.select(F.col("marks").alias("place"), F.regexp_extract("value", r"cluster_(\d+)", 1).cast("int").alias("cluster_id"))
    return places.join(text.read_consensus(spark, path), "cluster_id").select("place", "cluster_id", "num_reads", "seq")


@query("SELECT 2 AS round, vec_id::BIGINT AS read_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END::INT AS label FROM embeddings")
def file_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of two rounds and the beginning of a third; the last finished one is found and read."""
    root, state = _folder(spark, "rounds"), views.scored(spark, d).select("read_id", "label", "u_epi", "u_ale", "strength")
    for number, label in ((1, F.col("label")), (2, F.when(F.col("read_id") % 3 == 0, -1).otherwise(F.col("label")))):
        sinks.write_round({"state": state.withColumn("label", label), "sizes": state.groupBy("label").agg(F.count("*").alias("n"))}, root, number)
    state.limit(1).write.parquet(f"{root}/round=3/state")
    number = sinks.last_round(spark, root)
    return spark.read.parquet(f"{root}/round={number}/state").select(F.lit(number).alias("round"), "read_id", "label")


@query(R + "\nSELECT read_id::VARCHAR AS read_id, seq FROM r WHERE length(seq) >= 145 OR length(seq) < 40")
def file_globs(spark: SparkSession, d: str) -> DataFrame:
    """Reads of two lists of files, given by two globs; a third folder is in neither."""
    path, size = _folder(spark, "globs"), F.length("seq")
    rows = keep(views.reads(spark, d).select("read_id", "seq"))
    for name, part in (("long-a", size >= 145), ("short-b", size < 40), ("other", (size >= 40) & (size < 145))):
        sinks.write_reads(rows.where(part), f"{path}/{name}")
    return text.read_indexed(spark, [f"{path}/long-*/*", f"{path}/short-*/*"])


@query(R + "\nSELECT row_number() OVER (ORDER BY tag) AS place, tag FROM (SELECT DISTINCT tag FROM r EXCEPT SELECT DISTINCT tag FROM r WHERE length(seq) = 150 AND lang = 'de')")
def missing_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Missing ids, sorted: each with its place."""
    rows = views.reads(spark, d)
    absent = match.missing(rows, rows.where((F.length("seq") == 150) & (F.col("lang") == "de")), "tag")
    return voting.numbered(absent, "tag").select(F.col("line_no").cast("long").alias("place"), "tag")


@query(
    R
    + """,
e AS (SELECT substr(seq, 1, 7) AS anchor, read_id, CASE WHEN length(seq) % 3 = 0 AND length(seq) < 150 THEN NULL ELSE read_id END AS cluster FROM r WHERE length(seq) >= 14),
s AS (SELECT anchor, last(cluster ORDER BY read_id) AS cluster FROM e GROUP BY 1)
SELECT read_id, cluster FROM (SELECT read_id, right(seq, 7) AS anchor FROM r WHERE length(seq) >= 14) p LEFT JOIN s USING (anchor)"""
)
def anchor_lookup(spark: SparkSession, d: str) -> DataFrame:
    """An index of head anchors after inserts and deletes in order of read_id, a later insert taking an anchor over; tails are looked up."""
    rows = views.reads(spark, d).where(F.length("seq") >= 14)
    gone = (F.length("seq") % 3 == 0) & (F.length("seq") < 150)
    events = rows.select(F.substring("seq", 1, 7).alias("anchor"), F.when(~gone, F.col("read_id")).alias("cluster"), F.col("read_id").alias("at"))
    probes = rows.select("read_id", F.substring("seq", -7, 7).alias("anchor"))
    return match.look_up(probes, match.anchor_state(events)).select("read_id", "cluster")


# ---------------------------------------------------------------- founders and ids

_BLOCKS = _FOUND + ",\nblocks AS (SELECT f.founder AS cid, y.seq AS reference, f.read_id, x.seq FROM f JOIN r x USING (read_id) JOIN r y ON y.read_id = f.founder WHERE f.read_id <> f.founder)"


def _founder_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = views.reads(spark, d).select("read_id", "seq")
    return voting.founder_blocks(rows, _assignments(rows))


@query(_BLOCKS + "\nSELECT cid, reference, read_id, seq FROM blocks")
def founder_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _founder_blocks(spark, d)


@query(
    _BLOCKS
    + """,
parts AS (SELECT cid, 0 AS part, NULL::BIGINT AS read_id, reference AS seq FROM (SELECT DISTINCT cid, reference FROM blocks) UNION ALL SELECT cid, 1, read_id, seq FROM blocks)
SELECT dense_rank() OVER (ORDER BY cid) - 1 AS block_id, row_number() OVER (PARTITION BY cid ORDER BY part, read_id) - 1 AS pos, seq, part = 0 AS is_ref FROM parts"""
)
def file_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks written line by line in order over many files, whose ends cut blocks, and read again."""
    path = _folder(spark, "blocks")
    sinks.write_block_lines(_founder_blocks(spark, d), path)
    return text.read_blocks(spark, path)


@query(_FOUND + "\nSELECT read_id, founder AS cluster_id, r.seq FROM f JOIN r USING (read_id) WHERE n > 1")
def id_join(spark: SparkSession, d: str) -> DataFrame:
    """Reads with their cluster by id, founders in their own."""
    rows = views.reads(spark, d).select("read_id", "seq")
    return voting.join_assignments(rows, _assignments(rows)).select("read_id", "cluster_id", "seq")


@query(_FOUND + "\nSELECT count(*) AS n_reads, count(*) FILTER (read_id = founder) AS n_noise, round(count(*) FILTER (read_id = founder) / count(*)::DOUBLE, 6) AS noise_share FROM f")
def noise_share(spark: SparkSession, d: str) -> DataFrame:
    rows = views.reads(spark, d)
    return rounded(voting.noise_share(rows, _assignments(rows)))


@query("SELECT vec_id AS read_id, label::INT AS label FROM embeddings")
def kept_labels(spark: SparkSession, d: str) -> DataFrame:
    """New labels that are too few leave the old ones."""
    old = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("read_id"), F.col("label").cast("int").alias("label"))
    return voting.kept_labels(old, old.where("read_id % 2 = 0").withColumn("label", F.lit(-1)))


# ---------------------------------------------------------------- filters, cleaning, runs


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 5, 8, 13, 21, 34)")
def target_ids(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "part").where(F.col("p_partkey").isin(3, 5, 8, 13, 21, 34)).select("p_partkey", "p_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN 0.0 ELSE c_acctbal END::DOUBLE AS x FROM customer")
def finite_values(spark: SparkSession, d: str) -> DataFrame:
    """Null, not a number, infinite: 0."""
    k = F.col("c_custkey") % 5
    odd = F.when(k == 0, F.lit("NaN")).when(k == 1, F.lit("-Infinity")).when(k == 2, F.lit("no number")).otherwise(F.col("c_acctbal").cast("string"))
    return views.table(spark, d, "customer").select("c_custkey", metrics.finite(odd).alias("x"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND doc_id % 7 <> 0")
def whole_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"))
    return rows.dropna("any")


@query(R + "\nSELECT length(seq)::INT AS size, md5(string_agg(read_id::VARCHAR, ',' ORDER BY k)) AS members, run_batch FROM (SELECT *, (k - 1) // 32 AS run_batch FROM (SELECT read_id, seq, row_number() OVER (PARTITION BY length(seq) ORDER BY md5('0:' || read_id), read_id) AS k FROM r)) GROUP BY 1, 3")
def equal_runs(spark: SparkSession, d: str) -> DataFrame:
    """Reads of one length, shuffled among themselves, in batches of 32 that hold one length each."""
    rows = batches.equal_runs(views.reads(spark, d).select("read_id", F.length("seq").alias("size")), "read_id", "size", 32)
    rows = batches.shuffled(rows, "read_id").groupBy("size", "run_batch").agg(F.array_sort(F.collect_list(F.struct("place", "read_id"))).alias("m"))
    return rows.select("size", F.md5(F.array_join(F.transform("m", lambda x: x["read_id"].cast("string")), ",")).alias("members"), "run_batch")


@query(R + "\nSELECT tag, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, tag LIMIT 15")
def histogram_head(spark: SparkSession, d: str) -> DataFrame:
    """The 15 commonest tags: the head is the feature."""
    return views.reads(spark, d).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(15)


@query(R + "\nSELECT read_id, (row_number() OVER (ORDER BY md5('7:' || read_id), read_id))::BIGINT AS place FROM r")
def shuffle_all(spark: SparkSession, d: str) -> DataFrame:
    """Every read's place in a shuffle that is the same in every run."""
    rows = batches.shuffled(views.reads(spark, d).select("read_id"), "read_id", 7)
    return voting.numbered(rows.select("read_id", F.struct("place", "read_id").alias("at")), "at").select("read_id", F.col("line_no").cast("long").alias("place"))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 5")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").limit(5)


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def stamps(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"))


# ---------------------------------------------------------------- summaries


@query(R + "\nSELECT count(*) AS n_reads FROM r")
def row_count(spark: SparkSession, d: str) -> DataFrame:
    return views.reads(spark, d).agg(F.count("*").alias("n_reads"))


@query(PG + f"\nSELECT count(*) AS n, round(avg(score), 6)::DOUBLE AS mean_identity, count(*) FILTER (score > 0.99) AS n_perfect FROM (SELECT pred_id, max(round({_IDENT}, 9)) AS score FROM p, g WHERE abs(length(pred_seq) - length(gt_seq)) <= 10 GROUP BY 1)")
def identity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean identity of the best matches, and how many are all but perfect."""
    return rounded(match.identity_summary(match.best_by_identity(_pred(spark, d), views.references(spark, d))))


@query(TABLE + "\nSELECT unnest(['clusters: ' || count(*), 'largest: ' || max(size)::BIGINT]) AS value FROM maj")
def text_report(spark: SparkSession, d: str) -> DataFrame:
    majors = metrics.majorities(metrics.contingency(views.reads(spark, d), "cid", "lang"))
    return metrics.report(majors.agg(F.count("*").alias("clusters"), F.max("size").alias("largest")))


@query(
    R
    + """,
a AS (SELECT substr(seq, 1, 6) AS cluster_id, arg_min(substr(seq, 1, 15), read_id) AS core FROM r WHERE length(seq) >= 15 GROUP BY 1),
m AS (SELECT cluster_id, core, substr(seq, 1, 15) AS anchor, unnest(range(1, 16)) AS pos FROM r JOIN a ON substr(seq, 1, 6) = cluster_id WHERE length(seq) >= 15),
off AS (SELECT cluster_id, pos, substr(anchor, pos, 1) AS base, count(*) AS n FROM m WHERE substr(anchor, pos, 1) <> substr(core, pos, 1) GROUP BY 1, 2, 3),
spots AS (SELECT cluster_id, pos, sum(n) AS n, arg_min(base, (-n, base)) AS base FROM off GROUP BY 1, 2),
wrong AS (SELECT cluster_id, pos, base, n FROM (SELECT *, sum(n) OVER (PARTITION BY cluster_id) AS total FROM spots) WHERE n > 5 AND n > 0.12 * total),
fixed AS (SELECT cluster_id, arg_min(pos, (-n, pos)) AS pos, arg_min(base, (-n, pos)) AS base FROM wrong GROUP BY 1)
SELECT cluster_id, CASE WHEN pos IS NULL THEN core ELSE substr(core, 1, pos - 1) || base || substr(core, pos + 1) END AS core FROM a LEFT JOIN fixed USING (cluster_id)"""
)
def corrected_cores(spark: SparkSession, d: str) -> DataFrame:
    """Clusters are reads that share six bases. These reads are no copies of each other, so an eighth of all mismatches at a place is enough here."""
    rows = views.reads(spark, d).where(F.length("seq") >= 15).select("read_id", F.substring("seq", 1, 6).alias("cluster_id"), F.substring("seq", 1, 15).alias("anchor"))
    cores = rows.groupBy("cluster_id").agg(F.min_by("anchor", "read_id").alias("core"))
    return cluster.corrected_cores(rows.join(cores, "cluster_id"), share=0.12)


@query(
    "WITH " + G + """,
t AS (SELECT gt_id, gt_seq AS core, left(gt_seq, 9) || substr(gt_seq, 11, 9) || 'GG' || substr(gt_seq, 20, 10) || translate(substr(gt_seq, 30, 1), 'ACGT', 'CGTA') || substr(gt_seq, 31) AS seq FROM g WHERE length(gt_seq) >= 36)
SELECT gt_id, levenshtein(core, seq)::INT AS n, seq FROM t"""
)
def aligned_references(spark: SparkSession, d: str) -> DataFrame:
    """References aligned to copies of which a base is lost, two more and one changed: as many edits as the edit distance, and they make the copy."""
    core, cut = F.col("core"), lambda a, n: F.substr("core", F.lit(a), F.lit(n))
    seq = F.concat(cut(1, 9), cut(11, 9), F.lit("GG"), cut(20, 10), F.translate(cut(30, 1), "ACGT", "CGTA"), F.substr(core, F.lit(31)))
    rows = keep(views.references(spark, d).where(F.length("gt_seq") >= 36).select(F.col("gt_id").alias("cluster_id"), F.col("gt_id").alias("read_id"), F.col("gt_seq").alias("core")).withColumn("seq", seq))
    found = align.aligned(rows).join(rows, ["cluster_id", "read_id"])
    n = F.aggregate("edits", F.lit(0), lambda x, e: x + F.when(e["base"].startswith(align.MORE), F.length(e["base"]) - 1).otherwise(1))
    return found.select(F.col("cluster_id").alias("gt_id"), n.alias("n"), align.edited(F.col("core"), F.col("edits")).alias("seq"))


@query(
    "WITH " + G + """,
t AS (SELECT gt_id, left(gt_seq, 9) || substr(gt_seq, 11, 19) || translate(substr(gt_seq, 30, 1), 'ACGT', 'CGTA') || substr(gt_seq, 31) AS core, gt_seq FROM g WHERE length(gt_seq) >= 36)
SELECT gt_id AS cluster_id, CASE WHEN levenshtein(core, gt_seq) > 0 THEN gt_seq ELSE core END AS core, 7::BIGINT AS n_members FROM t"""
)
def mended_cores(spark: SparkSession, d: str) -> DataFrame:
    """Cores that lack a base and have a changed one, mended by seven members that have neither."""
    core = F.concat(F.substr("seq", F.lit(1), F.lit(9)), F.substr("seq", F.lit(11), F.lit(19)), F.translate(F.substr("seq", F.lit(30), F.lit(1)), "ACGT", "CGTA"), F.substr("seq", F.lit(31)))
    rows = views.references(spark, d).where(F.length("gt_seq") >= 36).select(F.col("gt_id").alias("cluster_id"), F.col("gt_seq").alias("seq"), F.explode(F.sequence(F.lit(1), F.lit(7)).cast("array<long>")).alias("read_id"))
    return align.corrected(keep(rows.withColumn("core", core))).select("cluster_id", "core", "n_members")


@query("SELECT idx - 1 AS idx, round(avg(x) * (1 - 0.5 ^ 4), 6) AS value FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS idx FROM embeddings) GROUP BY 1")
def federated_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Four rounds from 0 on, in which clients (labels) go half the way to the means of their own vectors, and count by their sizes: the mean of all, less a sixteenth."""
    rows = views.scored(spark, d).select("label", F.posexplode("embedding").alias("idx", "x"))
    own = keep(rows.groupBy(F.col("label").alias("client"), F.lit("layer").alias("param"), "idx").agg(F.avg("x").alias("value"), F.count("*").alias("n")))
    start = own.select("param", "idx", F.lit(0.0).alias("value")).distinct()
    found, _, _ = federated.loop(start, own.where("idx = 0").select("client", F.col("n").cast("double").alias("weight")), federated.pulled(own, 0.5), 4)
    return rounded(found.select("idx", "value"))


# ---------------------------------------------------------------- diagnostics on evidence


@query("SELECT event_id, round(least(1.0, epoch / 30.0), 6) AS rising, round(least(1.0, greatest(0.0, (epoch - 5) / 10.0)), 6) AS late FROM (SELECT event_id, event_id % 40 AS epoch FROM events)")
def annealing(spark: SparkSession, d: str) -> DataFrame:
    epoch = F.col("event_id") % 40
    return rounded(views.table(spark, d, "events").select("event_id", v.annealing(epoch, 30).alias("rising"), v.late_annealing(epoch).alias("late")))


_ENTROPY = _sum(lambda a: f"{a} / s * ln({a} / s)")


@query(E + f"\nSELECT read_id, round(1 / (1 - ({_ENTROPY})), 6) AS strength FROM ev")
def entropy_strength(spark: SparkSession, d: str) -> DataFrame:
    """Strength from the entropy of the expected probabilities."""
    return rounded(views.scored(spark, d).select("read_id", v.entropy_strength(_shares()).alias("strength")))


def _shares() -> Column:
    return F.transform("alpha", lambda a: a / v.total(F.col("alpha")))


@query(
    E
    + f""",
st AS (SELECT *, exp(1 / (1 - ({_ENTROPY}))) AS w FROM ev),
spots AS (SELECT label, w, unnest([0, 1, 2, 3]) AS idx, unnest([a1 - 1, a2 - 1, a3 - 1, a4 - 1]) AS x FROM st)
SELECT label, idx, round(avg(x), 6) AS plain, round(sum(w * x) / sum(w), 6) AS weighted FROM spots GROUP BY 1, 2"""
)
def fused_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = views.scored(spark, d).select("label", v.entropy_strength(_shares()).alias("strength"), F.transform("alpha", lambda a: a - 1).alias("evidence"))
    return rounded(federated.fused(rows, "label", "strength", "evidence"))


@query(
    E
    + f""",
off AS (SELECT read_id, {", ".join(f"CASE WHEN read_id % 4 = {i} THEN 1.0 ELSE a{i + 1} END AS a{i + 1}" for i in range(4))} FROM ev),
sized AS (SELECT *, a1 + a2 + a3 + a4 AS s FROM off)
SELECT read_id, round({_lgamma("s")} - {_lgamma("4.0")} + {_sum(lambda a: f"({a} - 1) * ({_psi(a)} - {_psi('s')}) - {_lgamma(a)}")}, 6) + 0.0 AS kl FROM sized"""
)
def kl_without_label(spark: SparkSession, d: str) -> DataFrame:
    """The divergence term of the loss: evidence of the label is taken out first."""
    rest = v.without_label(F.col("alpha"), (F.col("read_id") % 4).cast("int"))
    rows = views.scored(spark, d).select("read_id", rest.alias("rest"))
    return rows.select("read_id", (r6(v.dirichlet_kl(F.col("rest"))) + 0.0).alias("kl"))


@query("SELECT c_custkey, round(avg(c_acctbal / 7) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING), 6) AS mean FROM customer")
def running_means(spark: SparkSession, d: str) -> DataFrame:
    """A seventh of a balance, as means of cents would end on ties."""
    rows = views.table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 7).alias("x"))
    return rounded(federated.running_mean(rows, "c_nationkey", "c_custkey", "x").select("c_custkey", "mean"))


@query(RN + "\nSELECT read_id, replace(seq, 'N', 'A') AS decoded FROM rn")
def index_decode(spark: SparkSession, d: str) -> DataFrame:
    """Bases to indices and back; an N counts as A."""
    return views.reads(spark, d, "ACGTN").select("read_id", s.from_indices(s.one_hot(F.col("seq"))).alias("decoded"))


@query("SELECT 'n' || r_regionkey AS key, r_name AS value FROM region UNION ALL SELECT 'link' || r_regionkey, 'x://' || r_regionkey FROM region")
def file_config(spark: SparkSession, d: str) -> DataFrame:
    """JSON with remarks, one object for each region; // inside of a value stays."""
    path, key = _folder(spark, "config"), F.col("r_regionkey")
    body = F.concat(F.lit('{\n// a remark\n"n'), key, F.lit('": "'), F.col("r_name"), F.lit('",\n  // "m": 1,\n"link'), key, F.lit('": "x://'), key, F.lit('"\n}'))
    views.table(spark, d, "region").repartition(5, "r_regionkey").select("r_regionkey", body.alias("value")).write.partitionBy("r_regionkey").text(path)
    return text.read_config(spark, path)
