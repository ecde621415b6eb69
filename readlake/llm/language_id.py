"""Language identification by compression: the language whose dictionary makes the text smallest.

Dictionaries are raw content: slices, by their hash, of at most docs_per_lang training documents of each language (by hash of doc_id; pieces from
all over each text, sample_chars characters at most) fill dict_bytes. Each whole text, in lower case and in pieces, is compressed with every
dictionary; the smallest sum wins, ties by language name. A margin to the next language under min_margin marks the row
as rejected; lang_pred still names the closest language.

Defined results: null texts and texts without a letter are "und" with score 0 and rejected; so are all texts if there are
no training rows. Rows that repeat a doc_id are each predicted from their own text. lang, source and doc_id are never
inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import common as c
from readlake.llm.compression import LEVEL, PIECE, Compressors, filled, spread, summed_sizes

_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    docs_per_lang: int = 200
    sample_chars: int = 4096
    dict_bytes: int = 1 << 16
    level: int = LEVEL
    piece: int = PIECE
    min_margin: float = 0.005


def learn(docs: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """A dictionary for each lang of the training rows: a bounded sample goes to the driver, one pass over the texts."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~c.in_fold("doc_id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    place = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(1 << 40))
    most = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 1.5 * settings.docs_per_lang / n + 20 / n) * (1 << 40)))))
    sample = rows.where(place < most[F.col("lang")]).select("lang", place.alias("place"), spread(F.col("text"), settings.sample_chars).alias("pieces"))
    texts: dict[str, list[list[str]]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["place"], r["pieces"])):
        texts.setdefault(r["lang"], []).append([x.lower() for x in r["pieces"]])
    return {k: filled([x for pieces in v[: settings.docs_per_lang] for x in pieces], settings.dict_bytes) for k, v in sorted(texts.items())}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1, grows with the margin), rejected."""
    shared, langs = docs.sparkSession.sparkContext.broadcast([*dictionaries.values()]), [*dictionaries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = Compressors(shared.value, settings.level)
        for batch in batches:
            for part in c.slices(batch):
                texts = part.column("text").to_pylist()
                clear = [i for i, t in enumerate(texts) if t is not None and langs and _LETTER.search(t)]
                pred, score, gone = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
                if clear:
                    sizes = summed_sizes(ways, (texts[i].lower().encode("utf-8", "replace") for i in clear), settings.piece)
                    best = sizes.argmin(1)
                    pred[clear] = np.array(langs, object)[best]
                    ranked = np.sort(sizes, axis=1)
                    margin = 1 - ranked[:, 0] / ranked[:, 1] if len(langs) > 1 else np.ones(len(clear))
                    score[clear] = margin / (margin + 0.01)
                    gone[clear] = margin < settings.min_margin
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score), pa.array(gone)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document."""
    docs = c.table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", c.in_fold("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
