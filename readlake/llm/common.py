"""Shared pieces: checkpoint folder, input tables, and vectorised word arithmetic over Arrow batches.

A word is a maximal run of characters other than space and 0x09-0x0D. A null text has no words.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.session import importable

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names; one of our own only where it names none (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="readlake-checkpoint-"))


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


HEAVY_KEYS = 4096


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, values: list[str], spread: Column, most: int = HEAVY_KEYS) -> DataFrame:
    """rows with the values of counted (null where it has none): a left join whose hot keys need no adaptive splitting.

    counted has one row for each key and in column n how many rows have it; it should be cut from its lineage, as it is read three times.
    At most `most` keys can have more than sum(n) / most rows. These are broadcast, so that the bound is proven, and their rows go to the
    shuffled join under keys made from `spread`, a hash that differs from row to row. All keys are of type long.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    heavy = counted.where(F.col(n) > total // most).select(*(F.col(k).alias(f"heavy_{k}") for k in keys), F.struct(*values).alias("heavy_values"))
    marked = rows.join(F.broadcast(heavy), [F.col(k) == F.col(f"heavy_{k}") for k in keys], "left")
    is_heavy = F.col("heavy_values").isNotNull()
    marked = marked.withColumns({f"light_{k}": F.when(is_heavy, F.xxhash64(F.lit(i), spread)).otherwise(F.col(k)) for i, k in enumerate(keys)})
    light = counted.where(F.col(n) <= total // most).select(*(F.col(k).alias(f"light_{k}") for k in keys), F.struct(*values).alias("light_values"))
    joined = marked.join(light, [f"light_{k}" for k in keys], "left")
    found = F.when(is_heavy, F.col("heavy_values")).otherwise(F.col("light_values"))
    return joined.select(*rows.columns, *(found[v].alias(v) for v in values))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of tables that nothing refers to any more, and, where
    spark.cleaner.referenceTracking.cleanCheckpoints is on, their checkpoint files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def in_fold(doc_id: Column | str) -> Column:
    """True for held-out documents: crc32 of doc_id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0


def sampled_ids(labels: DataFrame, label: str, value: int, n: int) -> DataFrame:
    """At most n doc_ids of training-fold rows with that label, by hash order: a bounded, repeatable sample."""
    rows = labels.where((F.col(label) == value) & ~in_fold("doc_id") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).withColumn("label", F.lit(value))


# ---------------------------------------------------------------- words as numpy arrays

_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_CONTINUES = np.zeros(256, dtype=bool)
_CONTINUES[0x80:0xC0] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts on end (null: none), and the n + 1 offsets of the texts in it."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


class Words:
    """The words of a run of texts. start, end: byte ranges; first: index of each text's first word (n + 1 long)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, fold: bool = False):
        self.data, self.at = (_FOLD[data] if fold else data), at
        solid = _NOT_SPACE[self.data]
        before, after = np.zeros(len(solid), bool), np.zeros(len(solid), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        full = at[:-1][at[1:] > at[:-1]]
        before[full] = False
        after[full[full > 0] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.solid = solid

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def per_doc(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        size = (self.end - self.start).astype(np.int64)
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        loads = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        out = mix(size.astype(np.uint64) * _M1 + np.uint64(1))
        todo = np.arange(len(size))
        for k in range(8):
            left = size[todo] - 8 * k
            todo, left = todo[left > 0], left[left > 0]
            if not len(todo):
                return out
            part = loads[self.start[todo] + 8 * k]
            short = np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8)
            part = (part << short) >> short
            out[todo] = mix((out[todo] ^ part) * _M1)
        raw = self.data
        for i in todo[size[todo] > 64]:
            out[i] = xxhash.xxh3_64_intdigest(raw[self.start[i] : self.end[i]].tobytes())
        return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x5851F42D4C957F2D


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[:1] = down[:1] = 1
        _POWERS.clear()
        _POWERS[n] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[n]


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2^64, over mixed word hashes) of the window that starts at each word, over text ends too."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(10, int(len(words)).bit_length()))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:], dtype=np.uint64)
    return mix((sums[width:] - sums[:-width]) * down[:n])


def window_starts(words: Words, width: int) -> np.ndarray:
    """Indices of the words at which a window of that width starts and ends in the same text."""
    room = np.maximum(words.count - width + 1, 0)
    skip = np.repeat(words.first[:-1] - (np.cumsum(room) - room), room)
    return np.arange(room.sum()) + skip


def slices(batch: pa.RecordBatch, most: int = 4 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about that many bytes of text; a longer text is alone."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64)
    if not len(size):
        return
    run = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1), len(size)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def ids_of(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
