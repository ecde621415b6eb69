"""Toxicity by non-negative positive-unlabelled learning.

A numpy model over hashed words is trained from a bounded sample: at most max_positive confirmed toxic training documents and
max_unlabelled training documents whatever their label. Their whole texts are turned into features by the tasks that read them. The risk is that of Kiryo et al. (2017): prior * R+(1) +
max(0, R-unlabelled(0) - prior * R+(0)), with the logistic loss; a step that would take the second part under zero goes back up
instead. Features are the words (and starts of words) that stand out in the positive sample. The class prior is the share of toxic labels in the training rows, kept off 0 and 1 by EDGE. Scores come from whole texts: each distinct word
of a text counts once, weighed by a sigmoid of its sum.

Defined results: a null text counts as empty; empty texts get the score of the bias alone. Without a toxic training row
every score is EDGE. Rows that repeat a doc_id are scored each from their own text. Labels, lang, source and
doc_id are never inputs of a score; other columns of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import common as c

THRESHOLD, EDGE = 0.5, 1e-6


STARTS = (5, 6, 7)  # bytes of a word's start that are features of their own


@dataclass(frozen=True)
class Settings:
    max_positive: int = 2000
    max_unlabelled: int = 6000
    bits: int = 18
    min_docs: int = 5
    min_z: float = 4.0
    steps: int = 400
    rate: float = 0.03
    decay: float = 5e-4


@dataclass(frozen=True)
class Model:
    weights: np.ndarray | None
    bias: float
    prior: float
    bits: int


_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = 32
_LETTERS[65:91] = np.arange(65, 91)
_LETTERS[97:123] = np.arange(97, 123)


def word_slots(texts: pa.Array, bits: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, slot) of each distinct word and word start of each text, chosen slots only. Letters make words; A-Z folded."""
    data, at = c.text_bytes(texts)
    words = c.Words(_LETTERS[data], at, fold=True)
    doc, size = words.doc().astype(np.int64), words.end - words.start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = words.data
    first = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[words.start]
    pairs = []
    for k in (0, *STARTS):
        some = size > k
        hashed = c.mix((first[some] & np.uint64((1 << 8 * k) - 1)) + np.uint64(k)) if k else words.hashes()
        slot, of = (hashed >> np.uint64(64 - bits)).astype(np.int64), doc[some]
        if chosen is not None:
            ok = chosen[slot]
            slot, of = slot[ok], of[ok]
        pairs.append((of << bits) | slot)
    found = np.unique(np.concatenate(pairs))
    return found >> bits, found & ((1 << bits) - 1), len(at) - 1


class Sparse:
    """Rows of distinct slots, as flat arrays."""

    def __init__(self, slots: pa.ChunkedArray):
        self.n, self.slot = len(slots), np.asarray(pc.list_flatten(slots).combine_chunks()).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), np.asarray(pc.list_value_length(slots)))

    def keep(self, slots: np.ndarray) -> None:
        ok = slots[self.slot]
        self.row, self.slot = self.row[ok], self.slot[ok]

    def sums(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.slot], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.slot, weights=g[self.row], minlength=size)


def telling(positive: Sparse, unlabelled: Sparse, settings: Settings) -> np.ndarray:
    """Slots clearly commoner in the positive texts than in the unlabelled; passages that both share are not among them."""
    size = 1 << settings.bits
    n = np.bincount(positive.slot, minlength=size)
    p, u = n / positive.n, np.bincount(unlabelled.slot, minlength=size) / unlabelled.n
    z = (p - u) / np.sqrt(u * (1 - u) * (1 / positive.n + 1 / unlabelled.n) + 1 / positive.n**2)
    # of few positive texts, a tenth
    return (n >= max(1, min(settings.min_docs, positive.n // 10))) & (z > settings.min_z)


def nn_pu(positive: Sparse, unlabelled: Sparse, prior: float, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias, by full-batch Adam on the non-negative risk over the telling slots."""
    size = 1 << settings.bits
    chosen = telling(positive, unlabelled, settings)
    for part in (positive, unlabelled):
        part.keep(chosen)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    live = np.append(np.flatnonzero(chosen), size)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, settings.steps + 1):
        zp, zu = (part.sums(w[:-1]) + w[-1] for part in (positive, unlabelled))
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_positive, of_negative_p, of_negative_u = prior * (sp - 1) / len(sp), -prior * sp / len(sp), su / len(su)
        gp, gu = (of_positive + of_negative_p, of_negative_u) if negative >= 0 else (-of_negative_p, -of_negative_u)
        grad = np.append(positive.back(gp, size) + unlabelled.back(gu, size) + settings.decay * w[:-1], gp.sum() + gu.sum())[live]
        m[live] = 0.9 * m[live] + 0.1 * grad
        v[live] = 0.999 * v[live] + 0.001 * grad * grad
        w[live] -= settings.rate * (m[live] / (1 - 0.9**t)) / (np.sqrt(v[live] / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def slots_of(texts: DataFrame, bits: int) -> DataFrame:
    """place, slots: the distinct features of each whole text (place, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch):
                row, slot, n = word_slots(part.column("text"), bits)
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                yield pa.record_batch([part.column("place"), pa.ListArray.from_arrays(pa.array(ends), pa.array(slot.astype(np.int32)))], ["place", "slots"])

    return texts.select("place", "text").mapInArrow(run, "place long, slots array<int>")


def _sample(texts: DataFrame, most: int, bits: int) -> Sparse:
    """At most that many rows, by place; of a row come to the driver at most 2^bits numbers."""
    found = slots_of(texts, bits).orderBy("place", "slots").limit(most).toArrow()
    return Sparse(found.column("slots"))


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Two bounded samples go to the driver, by hash order of doc_id."""
    labels = labels.select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in labels.where(~c.in_fold("doc_id") & F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = min(1 - EDGE, max(EDGE, counts.get(1, 0) / max(1, sum(counts.values()))))
    if not counts.get(1):
        return Model(None, 0.0, prior, settings.bits)
    rows = docs.select("doc_id", F.xxhash64(F.lit(5), F.col("doc_id")).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    ids = c.sampled_ids(labels, "toxic", 1, settings.max_positive)
    # ids has max_positive rows at most, whatever the size of the input
    sure = _sample(rows.join(F.broadcast(ids.select("doc_id")), "doc_id"), settings.max_positive, settings.bits)
    pool = rows.where(~c.in_fold("doc_id"))
    n = pool.count()
    share = min(1.0, 1.2 * settings.max_unlabelled / max(1, n) + 100 / max(1, n))
    other = _sample(pool.where(F.pmod("place", F.lit(1 << 40)) < int(share * (1 << 40))), settings.max_unlabelled, settings.bits)
    if not sure.n or not other.n:
        return Model(None, 0.0, prior, settings.bits)
    weights, bias = nn_pu(sure, other, prior, settings)
    return Model(weights.astype(np.float32), bias, prior, settings.bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and toxic_score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        chosen = None if m.weights is None else m.weights != 0
        for batch in batches:
            for part in c.slices(batch):
                if m.weights is None:
                    p = np.full(part.num_rows, m.prior)
                else:
                    row, slot, n = word_slots(part.column("text"), m.bits, chosen)
                    p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=m.weights[slot], minlength=n) + m.bias, -30, 30)))
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(p)], ["doc_id", "toxic_score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, toxic_score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn(docs, c.table(spark, sf_dir, "labels")))
    return found.select("doc_id", c.in_fold("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
