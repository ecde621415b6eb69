"""Ranked lexical search over a bit-sliced impact index.

Terms are the maximal runs of letters, digits and characters beyond ASCII, A-Z in lower case; they are known by a 64-bit hash. One pass over the texts
counts, for each document, its terms and those that some item asks for; N, L and the document frequencies are sums over these
counts. Tasks then lay out blocks of BLOCK documents in order of doc_id: of each term the places of its documents and, for each
bit of the impact, a bitmap over these places. To answer an item, the slices of its terms are spread over the block and added by carry-save
arithmetic on bitmaps, all bits at a time; the K best are found from the most significant slice down, ties by place. A task
keeps K documents for each item; the rest is two ranked windows, by item and part, then by item.

Items are taken in groups of at most GROUP_TERMS terms (one item may have more), so that what each task is given of them is
bounded; each group is a pass over the texts, and a group holds thousands of items. All counts are exact 64-bit integers. A wrong
answer needs two terms of one 64-bit hash: with v terms asked for and t in all texts, v * t / 2^64 such pairs are expected.

Defined results: null and empty texts have no terms, and such documents count nowhere; an item without terms has no rows; item
rows that repeat an item_id are one item with the terms of all; a null item_id is an item. Documents that repeat a doc_id are ranked each
by itself; a null doc_id comes after all others of its score. No documents or no items: no rows. Other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from readlake.llm import common as c

K, BLOCK, GROUP_TERMS, PARTS = 50, 1 << 14, 1 << 18, 64
CACHE_BYTES = 128 << 20

_PLAIN = np.full(256, 32, np.uint8)  # what is in no term becomes a space
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _PLAIN[_a:_b] = np.arange(_a, _b)
_PLAIN[0x41:0x5B] += 32


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, text after text, and how many each text has."""
    data, at = c.text_bytes(texts)
    words = c.Words(_PLAIN[data], at)
    return words.hashes().view(np.int64), words.count


# ---------------------------------------------------------------- the index


@dataclass
class Block:
    """Documents in order of doc_id, bit i of a slice being the i-th of a term's places; slices from the least significant bit up."""

    ids: list
    terms: np.ndarray  # int32, ascending
    starts: np.ndarray  # of the places of each term, and their number
    places: np.ndarray  # uint16
    bits: np.ndarray  # slices of each term
    slices: bytes  # of term after term, slice after slice, each of whole bytes

    def __post_init__(self) -> None:
        self.bytes_each = (np.diff(self.starts) + 7) // 8
        self.at = np.concatenate([[0], np.cumsum(self.bytes_each * self.bits)])
        self.words = -(-len(self.ids) // 64)

    def spread(self, k: int, width: int) -> np.ndarray:
        """(width, words): the slices of the k-th term over all documents of the block, 0 above its own."""
        n, bits = int(self.starts[k + 1] - self.starts[k]), int(self.bits[k])
        packed = np.frombuffer(self.slices, np.uint8, int(self.at[k + 1] - self.at[k]), int(self.at[k])).reshape(bits, -1)
        dense = np.zeros((width, self.words * 64), np.uint8)
        dense[:bits, self.places[self.starts[k] : self.starts[k + 1]]] = np.unpackbits(packed, axis=1, count=n, bitorder="little")
        return np.packbits(dense, axis=1, bitorder="little").view(np.uint64)


def build(ids: list, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> Block:
    """A block of documents. doc: place in ids, term, impact (above 0): one entry for each document and term."""
    order = np.lexsort((doc, term))
    doc, term, impact = doc[order], term[order], impact[order].astype(np.uint64)
    terms, first = np.unique(term, return_index=True)
    starts = np.append(first, len(term))
    most = np.maximum.reduceat(impact, first) if len(terms) else np.zeros(0, np.uint64)
    bits = np.array([int(x).bit_length() for x in most], np.int64)
    out = []
    for k in range(len(terms)):
        own = impact[starts[k] : starts[k + 1]]
        sliced = (own[None, :] >> np.arange(bits[k], dtype=np.uint64)[:, None]) & np.uint64(1)
        out.append(np.packbits(sliced.astype(np.uint8), axis=1, bitorder="little").tobytes())
    return Block(ids, terms.astype(np.int32), starts, doc.astype(np.uint16), bits, b"".join(out))


def add(parts: list[np.ndarray]) -> np.ndarray:
    """The sum of bit-sliced numbers of equal shape (bits, words), which must hold it: carries are saved, and ripple once at the end."""
    total, carry = np.zeros_like(parts[0]), np.zeros_like(parts[0])
    for x in parts:
        half = total ^ carry
        both = total & carry
        total = half ^ x
        carry[1:] = ((half & x) | both)[:-1]
        carry[0] = 0
    up = np.zeros_like(total[0])
    for b in range(len(total)):
        half = total[b] ^ carry[b]
        total[b], up = half ^ up, (total[b] & carry[b]) | (half & up)
    return total


def top(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the k largest above 0, from the most significant slice down; equal ones by place."""
    sure, level = np.zeros_like(total[0]), np.bitwise_or.reduce(total, axis=0)
    for row in total[::-1]:
        above = level & row
        n = int(np.bitwise_count(sure | above).sum())
        if n > k:
            level = above
        else:
            sure, level = sure | above, level & ~row
            if n == k:
                level = np.zeros_like(level)
                break
    places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    found = places(sure)
    found = np.concatenate([found, places(level)[: k - len(found)]])
    ones = (total[:, found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)
    return found, (ones << np.arange(len(total), dtype=np.uint64)[:, None]).sum(axis=0).astype(np.int64)


def answer(block: Block, items: list[np.ndarray], k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each item (terms, ascending) that some document answers: its number, and places and scores of the k best."""
    kept: dict[int, np.ndarray] = {}
    size = 0
    most = (1 << block.bits) - 1
    for number, terms in enumerate(items):
        at = np.searchsorted(block.terms, terms)
        at = at[(at < len(block.terms)) & (block.terms[np.minimum(at, len(block.terms) - 1)] == terms)] if len(block.terms) else at[:0]
        if not len(at):
            continue
        width = int(most[at].sum()).bit_length()
        parts = []
        for i in at.tolist():
            if i not in kept:
                if size > CACHE_BYTES:
                    kept, size = {}, 0
                kept[i] = block.spread(i, int(block.bits[i]))
                size += kept[i].nbytes
            x = np.zeros((width, block.words), np.uint64)
            x[: len(kept[i])] = kept[i]
            parts.append(x)
        yield number, *top(add(parts), k)


# ---------------------------------------------------------------- on Spark


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): distinct hashes of each item's terms; items without one are absent."""
    kind = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("term", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch):
                hashes, n = terms_of(part.column("text"))
                ids = part.column("item_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([ids.cast(arrow.field(0).type), pa.array(hashes)], schema=arrow)

    return items.select("item_id", "text").mapInArrow(run, schema).groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with a term: n terms in all; of those in the vocabulary (sorted hashes) their places in it and numbers."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("n long, terms array<int>, tfs array<int>").fields])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in c.slices(batch):
                hashes, n = terms_of(part.column("text"))
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                pairs = np.repeat(np.arange(len(n)), n)[hit] * len(known) + at[hit]
                pairs, tf = np.unique(pairs, return_counts=True)
                doc, term = np.divmod(pairs, len(known))
                has = n > 0
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n))[has])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, tf)]
                ids = part.column("doc_id").filter(pa.array(has)).cast(arrow.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[has].astype(np.int64)), *(x.cast(arrow.field(2 + i).type) for i, x in enumerate(lists))], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def weights(counted: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """Of each term of the vocabulary, from its document frequency; one row of it comes for each term."""
    out = np.zeros(size, np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        out[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    return out


def index(counted: DataFrame, weight: np.ndarray, n_docs: int, total: int, block: int = BLOCK) -> DataFrame:
    """The index: a row for each block of documents, of at most `block` of a task's."""
    kind = counted.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *T.StructType.fromDDL("terms array<int>, starts array<int>, places binary, bits array<int>, slices binary").fields])
    arrow = to_arrow_schema(schema)
    shared = counted.sparkSession.sparkContext.broadcast(weight)

    def made(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([("doc_id", "ascending")])  # nulls last
        lists = rows.column("terms").combine_chunks()
        doc = np.repeat(np.arange(len(rows)), np.asarray(pc.list_value_length(lists)))
        term, tf = np.asarray(lists.flatten()), np.asarray(rows.column("tfs").combine_chunks().flatten()).astype(np.int64)
        m = 50 + 50 * np.asarray(rows.column("n")) * n_docs // total
        impact = shared.value[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        some = impact > 0
        b = build(rows.column("doc_id").to_pylist(), doc[some], term[some], impact[some])
        return pa.RecordBatch.from_pylist([{"ids": b.ids, "terms": b.terms, "starts": b.starts.astype(np.int32), "places": b.places.tobytes(), "bits": b.bits.astype(np.int32), "slices": b.slices}], arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while n + len(batch) >= block:
                yield made(pa.Table.from_batches([*held, batch.slice(0, block - n)]))
                batch, held, n = batch.slice(block - n), [], 0
            held.append(batch)
            n += len(batch)
        if n:
            yield made(pa.Table.from_batches(held))

    return counted.mapInArrow(run, schema)


def search(indexed: DataFrame, items: list[np.ndarray], k: int = K) -> DataFrame:
    """(item, doc_id, score): of each task the k best documents of each item (terms as places in the vocabulary, ascending)."""
    kind = indexed.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)
    shared = indexed.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for i in range(len(batch)):
                get = lambda n: batch.column(n)[i]
                ids = get("ids").as_py()
                b = Block(ids, np.asarray(get("terms").values), np.asarray(get("starts").values), np.frombuffer(get("places").as_py(), np.uint16), np.asarray(get("bits").values).astype(np.int64), get("slices").as_py())
                for number, places, scores in answer(b, shared.value, k):
                    found = [(-s, ids[p] is None, ids[p]) for p, s in zip(places.tolist(), scores.tolist(), strict=True)]
                    found += best.get(number, [])
                    best[number] = sorted(found, key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[:k]
        rows = [{"item": number, "doc_id": x, "score": -s} for number, found in best.items() for s, _, x in found]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return indexed.mapInArrow(run, schema)


def groups_of(items: DataFrame, most: int = GROUP_TERMS) -> Iterator[list[tuple]]:
    """Rows (item_id, terms) in groups by hash, of at most `most` terms each, if no item alone has more."""
    n, group = 1, lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    while True:
        sizes = items.groupBy(group(n).alias("g")).agg(F.sum(F.size("terms")).alias("size"), F.count("*").alias("items"))
        if not sizes.where((F.col("size") > most) & (F.col("items") > 1)).limit(1).count():
            break
        n *= 2
    for g in range(n):
        if rows := items.where(group(n) == g).collect():
            yield [(r["item_id"], r["terms"]) for r in rows]


def rank(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text) with a score above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    out = None
    for group in groups_of(c.cut(item_terms(items)), group_terms):
        vocabulary = np.unique(np.concatenate([np.array(terms, np.int64) for _, terms in group]))
        counted = c.cut(counts(docs, vocabulary))
        n_docs, total = counted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        weight = weights(counted, n_docs, len(vocabulary))
        asked = [np.searchsorted(vocabulary, np.sort(np.array(terms, np.int64))).astype(np.int32) for _, terms in group]
        found = search(index(counted, weight, n_docs, total, block), asked, k)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        parted = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
        parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
        ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(group)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])) if out is None else out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of the 50 best documents of every benchmark item."""
    return rank(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
len AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM len),
m AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM len, total),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
scored AS (SELECT q.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.doc_id = tf.doc_id GROUP BY q.item_id, tf.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
