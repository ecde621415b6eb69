"""Substring dedup: words covered by a window of words that also starts in a document with a smaller doc_id go.

Texts are packed into chunks of about chunk_bytes and cut from their lineage once, so that both passes see the same chunks.
Pass one takes the Rabin-Karp hash of every window of every chunk, keeps each distinct hash of the chunk with the smallest
doc_id that has it, and deals these by hash into buckets, many to a row (sorted, delta-coded, compressed). A bucket finds, for
each hash, the smallest doc_id over all chunks, and answers each chunk with one bit for each of its hashes: a smaller one exists
elsewhere. Pass two takes the same hashes again, applies the bits, merges repeated windows into maximal intervals of words,
and writes the words outside of them. Copies inside a chunk meet there, so a passage that a third of all documents hold
comes to each bucket once for each chunk, not once for each document. At sizes where a chunk has few hashes for a bucket
the rows get short, but there are never more of them than distinct (chunk, window) pairs.

A hash has 64 bits over mixed word hashes: with n windows, n * n / 2^65 pairs are expected to be taken for equal wrongly.

Defined results: null and empty texts have no words and nothing to remove; texts under `width` words have no window. Rows with
the same doc_id do not remove each other's words. A null doc_id counts as smaller than all others. Other columns are left alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import common as c

WIDTH = 50
CHUNK_BYTES = 8 << 20
BUCKET_WINDOWS = 2_000_000
_NULL = np.iinfo(np.int64).min


def _pack(values: np.ndarray) -> bytes:
    """8-byte numbers, equal places side by side, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).reshape(-1).view(kind)


def chunks(docs: DataFrame, width: int, chunk_bytes: int) -> DataFrame:
    """(chunk, n_windows, ids, sizes, blob): runs of rows with their texts compressed together; the first step of both passes."""
    schema = "chunk long, n_windows long, ids binary, sizes binary, blob binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, room = TaskContext.get().partitionId() << 32, [], 0

        def made() -> pa.RecordBatch:
            nonlocal at, held, room
            ids, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            windows = sum(h[3] for h in held)
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(h[2] for h in held))
            row = [pa.array([at], pa.int64()), pa.array([windows], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), sizes.tobytes(), blob))]
            at, held, room = at + 1, [], 0
            return pa.record_batch(row, ["chunk", "n_windows", "ids", "sizes", "blob"])

        for batch in batches:
            for part in c.slices(batch, chunk_bytes // 4):
                data, ends = c.text_bytes(part.column("text"))
                windows = int(np.maximum(c.Words(data, ends).count - width + 1, 0).sum())
                held.append((c.ids_of(part.column("doc_id")), np.diff(ends), data.tobytes(), windows))
                room += len(data)
                if room >= chunk_bytes:
                    yield made()
        if held:
            yield made()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Chunk:
    """The windows of a chunk: distinct hashes in order, the smallest doc_id of each, and which hash each window has."""

    def __init__(self, ids: bytes, sizes: bytes, blob: bytes, width: int):
        self.ids, sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.raw = zstandard.ZstdDecompressor().decompress(blob)
        self.words = c.Words(np.frombuffer(self.raw, np.uint8), self.at)
        self.begin = c.window_starts(self.words, width)
        self.of = self.ids[self.words.doc()[self.begin]]
        hashes = c.rolling(self.words.hashes(), width)[self.begin] if len(self.begin) else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        self.hashes = hashes[new]
        self.least = np.minimum.reduceat(self.of[order], np.flatnonzero(new)) if len(hashes) else self.of
        self.which = np.empty(len(hashes), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def cuts(self, buckets: int) -> np.ndarray:
        """Where each bucket's hashes begin; buckets are equal ranges of the upper 32 bits."""
        upper = [(b << 32) // buckets << 32 for b in range(1, buckets)]
        return np.concatenate([[0], np.searchsorted(self.hashes, np.array(upper, np.uint64)), [len(self.hashes)]])


def repeated(packed: DataFrame, buckets: int, width: int) -> DataFrame:
    """(chunk, bucket, bits): for each hash of the chunk in the bucket, whether a smaller doc_id in another chunk has it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["ids"], row["sizes"], row["blob"], width)
                cuts = chunk.cuts(buckets)
                for some in itertools.batched(np.flatnonzero(np.diff(cuts)).tolist(), 64):
                    parts = [slice(cuts[b], cuts[b + 1]) for b in some]
                    hashes = [_pack(np.diff(chunk.hashes[p], prepend=np.uint64(0))) for p in parts]
                    least = [_pack(chunk.least[p]) for p in parts]
                    yield pa.record_batch([pa.array(some, pa.int32()), pa.array([row["chunk"]] * len(some), pa.int64()), pa.array(hashes, pa.binary()), pa.array(least, pa.binary())], ["bucket", "chunk", "hashes", "least"])

    def answer(rows: pa.Table) -> pa.Table:
        hashes = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in rows.column("hashes").to_pylist()]
        least = [_unpack(x, np.int64) for x in rows.column("least").to_pylist()]
        ends = np.cumsum([len(h) for h in hashes])
        every, docs = np.concatenate(hashes), np.concatenate(least)
        order = np.argsort(every)
        every = every[order]
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        smallest = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        later = np.empty(len(every), bool)
        later[order] = docs[order] > smallest
        told = [(int(k), x) for k, x in zip(rows.column("chunk").to_pylist(), np.split(later, ends[:-1]), strict=True) if x.any()]
        bucket = rows.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array([k for k, _ in told], pa.int64()), "bucket": pa.array([bucket] * len(told), pa.int32()), "bits": pa.array([np.packbits(x).tobytes() for _, x in told], pa.binary())})

    dealt = packed.select("chunk", "ids", "sizes", "blob").mapInArrow(deal, "bucket int, chunk long, hashes binary, least binary")
    return dealt.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, bits binary")


def remove_repeats(docs: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed, removed (maximal intervals of word numbers, end exclusive), kept_text (words with one space)."""
    spark = docs.sparkSession
    packed = c.cut(chunks(docs, width, chunk_bytes))
    total = packed.agg(F.sum("n_windows")).first()[0] or 0
    buckets = max(-(-total // bucket_windows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    told = repeated(packed, buckets, width).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("told"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["ids"], row["sizes"], row["blob"], width)
                cuts, later = chunk.cuts(buckets), np.zeros(len(chunk.hashes), bool)
                for t in row["told"] or ():
                    a, b = cuts[t["bucket"]], cuts[t["bucket"] + 1]
                    later[a:b] = np.unpackbits(np.frombuffer(t["bits"], np.uint8), count=int(b - a)).astype(bool)
                gone = later[chunk.which] | (chunk.of > chunk.least[chunk.which])
                steps = np.zeros(len(chunk.words.start) + 1, np.int64)
                np.add.at(steps, chunk.begin[gone], 1)
                np.add.at(steps, chunk.begin[gone] + width, -1)
                yield from _written(chunk, np.cumsum(steps)[:-1] > 0)

    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start: int, end: int>>, kept_text string"
    return packed.select("chunk", "ids", "sizes", "blob").join(told, "chunk", "left").mapInArrow(apply, schema)


def _written(chunk: Chunk, covered: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The result rows of a chunk, a few MB of text at a time."""
    first, n_docs = chunk.words.first, len(chunk.ids)
    for a in range(0, n_docs, 500):
        b = min(n_docs, a + 500)
        kept, spans, removed = [], [], []
        for d in range(a, b):
            mask = covered[first[d] : first[d + 1]]
            words = chunk.raw[chunk.at[d] : chunk.at[d + 1]].split()
            if mask.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                words = [*itertools.compress(words, ~mask)]
            else:
                spans.append([])
            removed.append(int(mask.sum()))
            kept.append(b" ".join(words))
        ids = pa.array(chunk.ids[a:b], mask=chunk.ids[a:b] == _NULL)
        yield pa.record_batch(
            [ids, pa.array(chunk.words.count[a:b], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "removed", "kept_text"],
        )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    found = remove_repeats(c.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range(0, 50)) AS k)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM t),
kept AS (
  SELECT doc_id, count(gone.i) AS n_removed, string_agg(x, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS rest
  FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
