"""Line dedup: lines that many documents share stay in one document only. DataFrame functions only.

The key of a line is the line without white space at its ends, A-Z in lower case. Texts are exploded into lines, and each line
into the 128-bit hash of its key. Hashes are counted by document first and then by hash, both with map-side combine, which gives
the number of distinct documents, the largest doc_id and the number of lines of each hash. Hashes over the threshold are joined to
the positions of their lines; those with most lines are broadcast (their number is bounded by their counts), so that a line that
a third of all documents hold does not meet in one task. Positions are gathered per document, and the text is cut at these positions.

Defined results: a null text is one empty line; an empty text too. A key shorter than min_chars never goes. Rows that repeat
a doc_id are one document for the threshold, and are told apart by their texts when lines go. A null doc_id is one
document, smaller than all others. Other columns of the input pass through keep_lines() untouched.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm.common import LOWER, SPACES, UPPER, cut, free, join_counted, table


def _lower(text: Column) -> Column:
    """A-Z only. For texts of one-byte characters the built-in does the same, faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _key(line: Column) -> Column:
    """The line (in lower case already) without white space at its ends. Trimming walks through all characters, so it is left out where it does nothing."""
    ends = [f(line, F.lit(x)) for x in SPACES for f in (F.startswith, F.endswith)]
    return F.when(reduce(or_, ends), F.btrim(line, F.lit(SPACES))).otherwise(line)


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(-(2**63)))


def dropped_positions(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(id, text_hash, drops): the sorted 0-based positions of the lines that a row loses; rows that lose none are absent."""
    rows = docs.select(_id().alias("id"), F.xxhash64("text").alias("text_hash"), F.split(_lower(F.coalesce("text", F.lit(""))), "\n").alias("lines"))
    # an outer explode infers no filter, which would split the text a second time
    keys = rows.select("id", "text_hash", F.posexplode_outer("lines").alias("pos", "line")).withColumn("key", _key(F.col("line")))
    at = keys.where((F.octet_length("line") >= min_chars) & (F.char_length("key") >= min_chars)).select("id", "text_hash", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(7), F.col("key")).alias("b"))
    held = at.groupBy("id", "a", "b").agg(F.count("*").alias("n_lines"))
    hot = held.groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.max("id").alias("last"), F.sum("n_lines").alias("n_lines"))
    hot = cut(hot.where(F.col("n_docs") >= min_docs))
    found = join_counted(at, hot, ["a", "b"], "n_lines", ["last"], F.xxhash64("id", "text_hash", "pos")).where(F.col("id") != F.col("last"))
    # cut, so that the join to the texts has plain exchanges on both sides and adaptive execution can split it
    return cut(found.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("drops")))


def keep_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with the text cut (column text) and the struct dedup_lines(n_lines, n_dropped), which takes the place of any of that name."""
    docs = docs.drop("dedup_lines")
    id_, hash_, drops, cuts, every = (free(docs, n) for n in ("dedup_id", "dedup_hash", "dedup_drops", "dedup_cuts", "dedup_all"))
    found = dropped_positions(docs, min_chars, min_docs).toDF(id_, hash_, drops)
    joined = docs.join(found, (_id() == F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    # the runs of lines between two drops, so that the work is in proportion to the lines
    runs = F.transform(
        F.sequence(F.lit(1), F.size(cuts) - 1),
        lambda j: F.slice(F.col(every), F.element_at(cuts, j) + 2, F.element_at(cuts, j + 1) - F.element_at(cuts, j) - 1),
    )
    counts = F.struct(F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(drops), F.lit(0)).cast("long").alias("n_dropped"))
    joined = joined.withColumns({"dedup_lines": counts, cuts: F.concat(F.array(F.lit(-1)), F.col(drops), F.array(F.size(lines))), every: lines})
    text = F.when(F.col(drops).isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return joined.withColumn("text", text).drop(id_, hash_, drops, cuts, every)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    kept = keep_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "dedup_lines.n_lines", "dedup_lines.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT d.doc_id, u.pos, u.line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents d, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line
       FROM (SELECT string_split(coalesce(d.text, ''), chr(10)) AS parts)) u),
hot AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.pos, l.line, hot.last IS NOT NULL AND l.doc_id <> hot.last AS gone FROM lines l LEFT JOIN hot USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
