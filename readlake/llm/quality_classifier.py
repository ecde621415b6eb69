"""Quality classifier by compression: dictionaries of good and of bad labelled text, and a calibrated score.

A bounded sample of labelled training rows (at most per_class doc_ids of each label, by hash) is halved: one half fills the two
raw-content dictionaries with pieces from all over each text (at most sample_chars characters of a text), the other, read whole on
executors, calibrates. The feature is the normalised difference of compressed sizes, (bad - good) / mean; beside it stands how far
the text shrinks at all, since text that repeats itself fits both dictionaries alike. A logistic model of these, weighted to the
share of labels in the training rows, gives the score. Its fit is penalised and damped, so that it ends at the one least loss
however well the classes part; a feature whose weight would turn against its meaning is left out.

Defined results: a null text counts as empty; an empty text has difference 0 and gets the score of that. With fewer than two training
texts of some label every score is the share of label 1 (0.5 without labels). Labels that are null or neither 0 nor 1 are no
labels; a doc_id with both labels is in both classes. Rows that repeat a doc_id are scored each from their own text, and the
sample takes one text of them. Labels, lang, source and doc_id are never inputs of a score; other columns pass through keep_good().
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import common as c
from readlake.llm.compression import LEVEL, PIECE, Compressors, filled, spread, summed_sizes

THRESHOLD = 0.3
ORDINARY_RATE = -1.0  # log of compressed by plain bytes, under which text repeats itself
PENALTY, STILL = 1e-5, 1e-8


@dataclass(frozen=True)
class Settings:
    per_class: int = 800
    sample_chars: int = 4096
    dict_bytes: int = 1 << 16
    level: int = LEVEL
    piece: int = PIECE


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[bytes, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.5
    settings: Settings = field(default_factory=Settings)


def unshared(texts: list[str], width: int = 6) -> list[str]:
    """The texts without words that lie in a window of that width which two of the texts have: copies say nothing of a class.

    By window hashes in flat arrays, as the driver does this."""
    words = c.Words(*c.text_bytes(pa.array(texts, pa.large_string())))
    begin = c.window_starts(words, width)
    if not len(begin):
        return texts
    hashes, of = c.rolling(words.hashes(), width)[begin], words.doc()[begin]
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
    several = np.minimum.reduceat(of[order], first) < np.maximum.reduceat(of[order], first)
    shared = begin[order[np.repeat(several, np.diff(first, append=len(order)))]]
    steps = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(steps, shared, 1)
    np.add.at(steps, shared + width, -1)
    gone, out = np.cumsum(steps)[:-1] > 0, []
    for i, text in enumerate(texts):
        mask = gone[words.first[i] : words.first[i + 1]]
        out.append(b" ".join(itertools.compress(text.encode("utf-8", "replace").split(), ~mask)).decode("utf-8", "replace") if mask.any() else text)
    return out


def features(ways: Compressors, texts: list[bytes], piece: int) -> np.ndarray:
    """Per text: the normalised difference, and how far its rate without a dictionary is under that of ordinary text."""
    good, bad, plain = summed_sizes(ways, texts, piece).T
    rate = np.log(plain / np.array([max(1, len(t)) for t in texts], np.float64))
    return np.stack([20 * (bad - good) / (bad + good), np.minimum(rate - ORDINARY_RATE, 0), np.ones(len(texts))], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights of the least penalised loss; x ends in a column of ones. The other columns must not speak against label 1.

    Newton's method on standardised columns, each step halved until the loss falls. The loss is strictly convex, so this ends at its
    one minimum, which classes that part without error do not push to infinity; it begins at the share of label 1.
    """
    share = weight / weight.sum()
    mean = share @ x[:, :-1]
    scale = np.sqrt(share @ (x[:, :-1] - mean) ** 2)
    live = scale > 1e-9
    while True:
        z = np.column_stack([(x[:, :-1][:, live] - mean[live]) / scale[live], np.ones(len(y))])
        rate = np.clip(share @ y, 1e-6, 1 - 1e-6)
        w = np.append(np.zeros(live.sum()), np.log(rate / (1 - rate)))
        pull = np.append(np.full(live.sum(), penalty), 1e-9)
        loss = lambda v: share @ np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ v)) + 0.5 * pull @ v**2
        slope = lambda v: z.T @ (share * (0.5 * (1 + np.tanh(0.5 * (z @ v))) - y)) + pull * v
        for _ in range(200):
            grad = slope(w)
            if np.abs(grad).max() < STILL:
                break
            p = 0.5 * (1 + np.tanh(0.5 * (z @ w)))
            step, now, size = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + np.diag(pull), grad), loss(w), 1.0
            while size > 1e-12 and loss(w - size * step) > now - 1e-4 * size * (grad @ step):
                size /= 2
            w = w - size * step
        if not np.abs(slope(w)).max() < 1e-5:
            raise ArithmeticError(f"the fit did not settle: weights {w}, slope {slope(w)}")
        if (w[:-1] >= 0).all():
            break
        live[np.flatnonzero(live)[w[:-1] < 0]] = False
    out = np.zeros(x.shape[1])
    out[:-1][live] = w[:-1] / scale[live]
    out[-1] = w[-1] - (w[:-1] / scale[live]) @ mean[live]
    return out


def sampled_pieces(docs: DataFrame, ids: DataFrame, settings: Settings) -> dict[int, list[list[str]]]:
    """Of each label, the pieces of each sampled text, in a fixed order; a row for each id and label goes to the driver."""
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", spread(F.coalesce("text", F.lit("")), settings.sample_chars).alias("pieces"))
    rows = rows.groupBy("doc_id", "label").agg(F.min("pieces").alias("pieces")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return {k: [r["pieces"] for r in rows if r["label"] == k] for k in (0, 1)}


def sampled_features(docs: DataFrame, ids: DataFrame, dictionaries: tuple[bytes, ...], settings: Settings) -> np.ndarray:
    """label and features of each sampled text, read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = Compressors([*shared.value], settings.level)
        for batch in batches:
            for part in c.slices(batch):
                data, at = c.text_bytes(part.column("text"))
                raw = data.tobytes()
                x = features(ways, [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], settings.piece)
                yield pa.record_batch([part.column("doc_id"), part.column("label"), pa.array([*x], pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(run, "doc_id long, label int, x array<double>")
    rows = rows.groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r["label"], r["doc_id"]))
    return np.array([[r["label"], *r["x"]] for r in rows], np.float64).reshape(-1, 4)


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1))
    counts = {r["quality"]: r["n"] for r in labels.where(~c.in_fold("doc_id")).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    # ids has 2 * per_class rows at most, whatever the size of the input
    ids = c.cut(c.sampled_ids(labels, "quality", 0, settings.per_class).unionByName(c.sampled_ids(labels, "quality", 1, settings.per_class)))
    first = F.xxhash64(F.lit(1), F.col("doc_id")) >= 0
    texts = sampled_pieces(docs, ids.where(first), settings)
    if not all(map(len, texts.values())):
        return Model(prior=prior, settings=settings)
    own = unshared([" ".join(t) for t in texts[1] + texts[0]])
    own = {1: own[: len(texts[1])], 0: own[len(texts[1]) :]}
    made = (*(filled(own[k], settings.dict_bytes) for k in (1, 0)), b"")
    seen = sampled_features(docs, ids.where(~first), made, settings)
    x, y = seen[:, 1:], seen[:, 0]
    if not 0 < y.sum() < len(y):
        return Model(prior=prior, settings=settings)
    share = np.where(y == 1, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1)) * len(y)
    return Model(made, tuple(logistic(x, y, share)), prior, settings)


def score(docs: DataFrame, model: Model, out: str = "quality_score") -> DataFrame:
    """docs with one more column, the score."""
    from pyspark.sql.types import DoubleType, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields]).add(out, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        ways = Compressors([*m.dictionaries], m.settings.level) if m.weights else None
        for batch in batches:
            for part in c.slices(batch):
                if ways is None:
                    p = np.full(part.num_rows, m.prior)
                else:
                    data, at = c.text_bytes(part.column("text"))
                    raw = data.tobytes()
                    x = features(ways, [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], m.settings.piece)
                    p = 1 / (1 + np.exp(-np.clip(x @ np.array(m.weights), -30, 30)))
                yield pa.record_batch([*part.columns, pa.array(p)], [*part.schema.names, out])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is at least the threshold, with the columns of docs."""
    out = c.free(docs, "quality_score")
    return score(docs, model, out).where(F.col(out) >= threshold).drop(out)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn(docs, c.table(spark, sf_dir, "labels")))
    return found.select("doc_id", c.in_fold("doc_id").alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
