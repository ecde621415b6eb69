"""Benchmark decontamination by SimHash of item-sized windows. DataFrame and SQL functions only.

Texts are A-Z folded and cut into words; a shingle is five words (an item under five words is one shingle). A window of a
document is as long as an item and lies where a shingle of the document meets the same shingle of some item of that
length, moved inside the document at its ends; a window without a common shingle has similarity 0 to every item. Each window
and each item gets a SimHash of 256 bits of its shingles, counted with their multiplicity. The bits are cut into 32 blocks of 8. Two
fingerprints within radius 63 differ in at most one bit of some block, so an index of every block of every item, one side of it under each
change of one bit or none, finds all of them by a join on one key. At so wide a radius any complete index meets many unlike pairs of one
length (here two thirds of them, 1.1 times on average); narrow blocks keep what a window asks to 32 keys. A pair counts at its first such
block only. What is within the radius is verified exactly: sum of least multiplicities over sum of greatest, against min_similarity.
Only keys, fingerprints and numbers of windows go through the index; words are joined to the pairs within the radius. Items of more
than 16,000 shingles, which the counters of the fingerprint don't hold, are verified without it.

At similarity 0.8 about 39 of 256 bits differ, with deviation 5.8: the radius lies over four deviations out.
The table of item shingles and the index are broadcast only if they have at most broadcast_rows rows, counted first. Changed bits are on the
items' side (288 rows an item, 32 a window) if that can be broadcast, else on the windows' side if 32 rows an item can, else on the items'
side in a shuffled join. Where item shingles are shuffled, windows fetch their words from the texts after the join.

Defined results: null and empty texts and items match nothing. A document shorter than an item is one window. Items may repeat
an item_id; a null item_id matches but is not listed. Rows that repeat a doc_id are judged together: what one of them holds, all hold.
Columns besides doc_id and text pass through keep_clean().
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import common as c
from readlake.llm.line_dedup import _lower

WIDTH, MIN_SIMILARITY, BROADCAST_ROWS = 5, 0.8, 1_000_000
PARTS, BLOCKS, BITS, APART = 4, 32, 8, 1  # longs of a fingerprint; blocks, bits of each, and bits of a block that may differ
RADIUS, LONGEST = BLOCKS * (APART + 1) - 1, 16_000
_LANES, _LANE = 0x0001000100010001, 16


def words(text: Column) -> Column:
    """Folded words; a text without any gives one empty word, which no text with words has."""
    return F.split(F.btrim(_lower(F.coalesce(text, F.lit(""))), F.lit(c.SPACES)), r"[\x20\x09-\x0D]+")


def shingle(array: str, at: Column, width: int) -> Column:
    """64-bit hash of the shingle that begins at that word."""
    return F.xxhash64(*(F.get(F.col(array), at + F.lit(k)) for k in range(width)))


def shingles(array: str, width: int) -> Column:
    """64-bit hashes of the shingles of an array of words, in order."""
    begin = F.sequence(F.lit(0), F.size(array) - width)
    return F.when(F.size(array) >= width, F.transform(begin, lambda i: shingle(array, i, width))).otherwise(F.array().cast("array<long>"))


def with_shingles(rows: DataFrame, array: str, width: int) -> DataFrame:
    """A row for each shingle, with pos and h. No lambda, so that it stays inside generated code."""
    # an outer explode infers no filter, which would make the words a second time
    begin = F.when(F.size(array) >= width, F.sequence(F.lit(0), F.size(array) - width))
    return rows.withColumn("pos", F.explode_outer(begin)).where("pos IS NOT NULL").withColumn("h", shingle(array, F.col("pos"), width))


def with_print(rows: DataFrame, array: str, width: int, name: str) -> DataFrame:
    """rows, distinct, with their SimHash as an array of longs; null where there are over LONGEST shingles.

    A bit is set if more than half of the shingles' hashes have it set. Four counters of 16 bits lie side by side in a long.
    """
    keys = rows.columns
    parts = [F.xxhash64(F.lit(i), F.col("h")).alias(f"x{i}") for i in range(PARTS)]
    sums = [F.sum(F.shiftrightunsigned(f"x{i}", k).bitwiseAND(F.lit(_LANES))).alias(f"s{i}_{k}") for i in range(PARTS) for k in range(_LANE)]
    short = F.size(array) < LONGEST + width
    counted = with_shingles(rows.where(short), array, width).select(*keys, *parts).groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    over = (F.lit((1 << 14) - 1) - F.floor(F.col("n") / 2)) * F.lit(_LANES)  # lifts a counter over half of n to bit 14
    bits = lambda i, k: F.shiftleft(F.shiftrightunsigned(F.col(f"s{i}_{k}") + over, 14).bitwiseAND(F.lit(_LANES)), k)

    def part(i: int) -> Column:
        out = bits(i, 0)
        for k in range(1, _LANE):
            out = out.bitwiseOR(bits(i, k))
        return out

    found = counted.select(*keys, F.array(*(part(i) for i in range(PARTS))).alias(name))
    return found.unionByName(rows.where(~short).distinct().withColumn(name, F.lit(None).cast("array<long>")))


def _masks(most: int) -> list[int]:
    """The changes of at most that many bits of a block."""
    return [sum(1 << b for b in some) for n in range(most + 1) for some in combinations(range(BITS), n)]


def with_keys(rows: DataFrame, name: str, turned: int) -> DataFrame:
    """A row for each block and each change of at most `turned` bits, with block and key: length, block and bits in one number."""
    out = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("value", F.expr(f"shiftrightunsigned({name}[block div 8], 8 * (block % 8)) & 255L"))
    out = out.withColumn("change", F.explode(F.lit(_masks(turned)).cast("array<long>")))
    key = F.expr("shiftleft(CAST(length AS BIGINT), 24) | shiftleft(CAST(block AS BIGINT), 16)").bitwiseOR(F.col("value").bitwiseXOR(F.col("change")))
    return out.withColumn("key", key).drop("value", "change")


def _first_meeting(a: str, b: str) -> Column:
    """Whether two fingerprints are within the radius, and this block is the first that differs in APART bits or fewer."""
    apart = [F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) for i in range(PARTS)]
    block = lambda i: F.shiftrightunsigned(apart[i // 8], 8 * (i % 8)).bitwiseAND(F.lit(255))
    first = F.coalesce(*(F.when(F.bit_count(block(i)) <= APART, F.lit(i)) for i in range(BLOCKS)))
    return (sum((F.bit_count(x) for x in apart), F.lit(0)) <= RADIUS) & (F.col("block") == first)


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two arrays as multisets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    common = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.expr(f"aggregate(array_distinct({a}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"))
    return F.when(F.size(a) + F.size(b) > 0, common / (F.size(a) + F.size(b) - common)).otherwise(0.0)


def windows(docs: DataFrame, items: DataFrame, width: int, broadcast: bool) -> DataFrame:
    """(doc_id, length, start, words): the places of documents where a shingle lies as in some item, each once."""
    where = with_shingles(items.select("length", "w"), "w", width).select("length", F.col("pos").alias("offset"), "h").distinct()
    texts = docs.select("doc_id", words(F.col("text")).alias("w"))
    begin = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.size("w") - F.col("length")))
    taken = F.array_join(F.slice("w", F.col("start") + 1, F.least(F.col("length"), F.size("w"))), " ").alias("words")
    if broadcast:
        hit = with_shingles(texts, "w", width).join(F.broadcast(where), "h").withColumn("start", begin)
        return hit.select("doc_id", "length", "start", taken).distinct()
    # words stay with the texts until the shuffled join has told the windows
    texts = texts.withColumn("row_hash", F.xxhash64("w"))
    hit = with_shingles(texts, "w", width).select("doc_id", "row_hash", "h", "pos", F.size("w").alias("n")).join(where, "h")
    begin = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.col("n") - F.col("length")))
    found = hit.select(F.col("doc_id").alias("of"), F.col("row_hash").alias("of_hash"), "length", begin.alias("start")).distinct()
    return texts.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row_hash") == F.col("of_hash"))).select("doc_id", "length", "start", taken).distinct()


def met(windows: DataFrame, items: DataFrame, n_items: int, broadcast_rows: int) -> DataFrame:
    """(window, item_hash) of the fingerprints of one length within the radius, each pair once. windows: window, length, print; items: item_hash, length, item_print.

    A key holds the block and all bits of it, so a pair meets at a block under one change at most.
    """
    entries = n_items * BLOCKS
    small = F.broadcast if entries <= broadcast_rows else (lambda df: df)
    on_items = entries * len(_masks(APART)) <= broadcast_rows or entries > broadcast_rows
    index = with_keys(items, "item_print", APART if on_items else 0).select("key", "item_hash")
    asked = with_keys(windows, "print", 0 if on_items else APART).select("key", "block", "window", "print")
    prints = small(items.select("item_hash", "item_print"))
    return asked.join(small(index), "key").join(prints, "item_hash").where(_first_meeting("print", "item_print")).select("window", "item_hash")


def candidates(docs: DataFrame, items: DataFrame, width: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """The windows (see windows()), and the pairs of windows and items that the index finds within the radius."""
    n = items.agg(F.sum("length").alias("n"), F.count("*").alias("items")).first()
    found = windows(docs, items, width, n["n"] <= broadcast_rows).withColumn("w", F.split("words", " "))
    found = with_print(found.select("doc_id", "length", "start", "w"), "w", width, "print")
    found = c.cut(found.withColumn("window", F.xxhash64("doc_id", "length", "start", "w")))
    own = with_print(items.select("item_id", "length", "w"), "w", width, "item_print").withColumnRenamed("w", "item_w")
    own = c.cut(own.withColumn("item_hash", F.xxhash64("item_id", "item_w")))
    pairs = met(found.where("print IS NOT NULL"), own.where("item_print IS NOT NULL"), n["items"], broadcast_rows)
    few = F.broadcast if n["n"] <= broadcast_rows else (lambda df: df)
    near = found.join(pairs, "window").join(few(own.select("item_hash", "item_id", "item_w")), "item_hash")
    long = found.where("print IS NULL").join(own.where("item_print IS NULL"), "length")
    columns = ["doc_id", "start", "w", "item_id", "item_w"]
    return found, near.select(*columns).unionByName(long.select(*columns))


def matches(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, start (word number), similarity: windows of documents that are an item, or nearly."""
    items = c.cut(benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.get("w", F.lit(0)) != "").withColumn("length", F.size("w")).distinct())
    widths = sorted(r["width"] for r in items.select(F.least("length", F.lit(WIDTH)).alias("width")).distinct().collect())
    found = None
    for width in widths:
        _, pairs = candidates(docs, items.where(F.least("length", F.lit(WIDTH)) == width), width, broadcast_rows)
        pairs = pairs.withColumns({"hashes": shingles("w", width), "item_hashes": shingles("item_w", width)}).withColumn("similarity", similarity("hashes", "item_hashes"))
        part = pairs.where(F.col("similarity") >= min_similarity).select("doc_id", "item_id", "start", "similarity")
        found = part if found is None else found.unionByName(part)
    empty = docs.where(F.lit(False)).select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))
    return empty if found is None else found


def flag(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, contaminated, items (sorted item_ids), similarity (the greatest; 0 if none) of every row of docs."""
    by_doc = matches(docs, benchmark, min_similarity).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity"))
    by_doc = by_doc.withColumnRenamed("doc_id", "of")
    joined = docs.select("doc_id").join(by_doc, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return joined.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    leaks = matches(docs, benchmark, min_similarity).select(F.col("doc_id").alias("leak_id")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak_id"]), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, items (item_ids in order, with commas) and similarity of every document."""
    found = flag(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join("items", ","))


ORACLE = r"""
WITH lowered AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
t AS (
  SELECT kind, id, w, len(w) AS n FROM (
    SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM lowered)
  WHERE len(w) > 0),
items AS (SELECT id AS item_id, w, n, least(n, 5) AS width FROM t WHERE kind = 'i'),
item_grams AS (SELECT item_id, n, width, i - 1 AS off, array_to_string(w[i : i + width - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - width + 2)) AS i FROM items)),
doc_grams AS (
  SELECT id AS doc_id, n, width, i - 1 AS pos, array_to_string(w[i : i + width - 1], ' ') AS g
  FROM (SELECT t.id, t.w, t.n, k.width, unnest(range(1, t.n - k.width + 2)) AS i FROM t, (SELECT DISTINCT width FROM items) k WHERE kind = 'd')),
spots AS (
  SELECT DISTINCT d.doc_id, i.n AS length, i.width, least(i.n, d.n) AS n, greatest(0, least(d.pos - i.off, d.n - i.n)) AS start
  FROM doc_grams d JOIN item_grams i ON d.width = i.width AND d.g = i.g),
inside AS (
  SELECT s.doc_id, s.length, s.start, s.width, d.g, count(*) AS k FROM spots s JOIN doc_grams d
  ON d.doc_id = s.doc_id AND d.width = s.width AND d.pos >= s.start AND d.pos <= s.start + s.n - s.width GROUP BY ALL),
item_bags AS (SELECT item_id, n, width, g, count(*) AS k FROM item_grams GROUP BY ALL),
pairs AS (
  SELECT x.doc_id, x.length, x.start, y.item_id, sum(least(x.k, y.k)) AS shared FROM inside x JOIN item_bags y ON y.n = x.length AND y.g = x.g GROUP BY ALL),
found AS (
  SELECT p.doc_id, p.item_id, shared::DOUBLE / ((p.length - s.width + 1) + (s.n - s.width + 1) - shared) AS similarity
  FROM pairs p JOIN spots s ON s.doc_id = p.doc_id AND s.length = p.length AND s.start = p.start),
hits AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items, max(similarity) AS similarity
  FROM found WHERE similarity >= 0.8 GROUP BY doc_id)
SELECT d.doc_id, h.doc_id IS NOT NULL AS contaminated, coalesce(array_to_string(h.items, ','), '') AS items, coalesce(h.similarity, 0.0)::DOUBLE AS similarity
FROM documents d LEFT JOIN hits h USING (doc_id)
"""
