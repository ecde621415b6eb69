"""Quality rules as a short-circuit cascade.

A bounded sample (by hash of doc_id) runs every rule on executors, which send back only time and rejections per rule. What a rule
costs is what it takes beyond the base measures, which every document needs anyway, and it is tried on the texts that
pass the base rule, each rule from the same start, so that neither the given order nor texts that never come to it
count. Rules are then ordered by rejections per second, so that most documents that go meet their rule early; the order changes
the cost, never the verdict, as a document stays only if all rules pass.

Defined results: null and empty texts have no words, so n_words = 0 and base_failed. A rule whose denominator is 0 passes
(the base rule on the number of words has the say). Rows that repeat a doc_id are judged each on its own. Columns besides
doc_id and text are left alone.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import common as c

# ---------------------------------------------------------------- measures: one number for each text of a batch

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[192:] = True  # of a character beyond ASCII, the first byte
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


class Measures:
    """Measures of a batch of texts, each computed once, when first asked for."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.words, self.got = c.Words(data, at), {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.got:
            self.got[name] = getattr(self, name)()
        return self.got[name]

    def copy(self) -> Measures:
        out = object.__new__(Measures)
        out.words, out.got = self.words, dict(self.got)
        return out

    def only(self, some: np.ndarray) -> Measures:
        """Of some of the texts, with what is measured already."""
        if len(some) == len(self.words.count):
            return self.copy()
        data, at = self.words.data, self.words.at
        out = Measures(np.concatenate([data[:0], *(data[at[i] : at[i + 1]] for i in some)]), np.concatenate([[0], np.cumsum(np.diff(at)[some])]))
        out.got = {k: v[some] for k, v in self.got.items()}
        return out

    def n_words(self) -> np.ndarray:
        return self.words.count

    def word_chars(self) -> np.ndarray:
        return self.words.per_doc(self.words.solid & ~c._CONTINUES[self.words.data])

    def n_symbols(self) -> np.ndarray:
        return self.words.per_doc(_SYMBOL[self.words.data])

    def n_lines(self) -> np.ndarray:
        return self.words.per_doc(self.words.data == 10) + 1

    def n_dup_lines(self) -> np.ndarray:
        out, data, at = np.zeros(len(self.words.count), np.int64), self.words.data.tobytes(), self.words.at
        for i in np.flatnonzero(self["n_lines"] > 1):
            lines = [x for x in data[at[i] : at[i + 1]].split(b"\n") if x and not x.isspace()]
            out[i] = len(lines) - len(set(lines))
        return out

    def n_repeat_words(self) -> np.ndarray:
        """Words in 3-word windows found twice or more in the text."""
        w, out = self.words, np.zeros(len(self.words.count), np.int64)
        begin = c.window_starts(w, 3)
        if not len(begin):
            return out
        doc = w.doc()
        keys = c.mix(c.rolling(w.hashes(), 3)[begin] ^ c.mix(doc[begin].astype(np.uint64) * c._M1))
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        twice = np.zeros(len(keys), bool)
        twice[1:] |= same
        twice[:-1] |= same
        marks, hit = np.zeros(len(doc), bool), begin[order[twice]]
        for k in range(3):
            marks[hit + k] = True
        return np.bincount(doc[marks], minlength=len(out)).astype(np.int64)

    def alpha_words(self) -> np.ndarray:
        w = self.words
        sums = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(_ALPHA[w.data], out=sums[1:])
        return np.bincount(w.doc()[sums[w.end] > sums[w.start]], minlength=len(w.count)).astype(np.int64)

    def capitals(self) -> np.ndarray:
        return self.words.per_doc(_CAPITAL[self.words.data])

    def letters(self) -> np.ndarray:
        """A-Z, a-z, and every character beyond ASCII, which counts as a letter without case."""
        return self.words.per_doc(_ALPHA[self.words.data])


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(data: np.ndarray, at: np.ndarray) -> Measures:
    """With the base measures, which every text gets."""
    m = Measures(data, at)
    for name in BASE:
        m[name]
    return m


def base_failed(m: Measures) -> np.ndarray:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


@dataclass(frozen=True)
class Rule:
    """A text passes if low * bottom <= top <= high * bottom."""

    name: str
    top: str
    bottom: str
    low: float
    high: float

    def rejects(self, m: Measures) -> np.ndarray:
        top, bottom = m[self.top], m[self.bottom]
        return (bottom > 0) & ((top < self.low * bottom) | (top > self.high * bottom))


RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols per word", "n_symbols", "n_words", 0.0, 0.1),
    Rule("repeated lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("words with a letter", "alpha_words", "n_words", 0.8, 1.0),
    Rule("capitals among letters", "capitals", "letters", 0.0, 0.5),
)
SAMPLE_ROWS = 512


def rank_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on at most sample_rows documents. Ties and an empty sample keep the given order."""
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    ids = [r[0] for r in ids.collect()]
    if not ids:
        return list(rules)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch):
                m = measured(*c.text_bytes(part.column("text")))
                m = m.only(np.flatnonzero(~base_failed(m)))
                took, gone = [], []
                for rule in rules:
                    fresh = m.copy()
                    began = time.perf_counter()
                    gone.append(int(rule.rejects(fresh).sum()))
                    took.append(time.perf_counter() - began)
                yield pa.record_batch({"rule": pa.array([r.name for r in rules]), "took": pa.array(took), "gone": pa.array(gone, pa.int64())})

    rows = docs.where(F.col("doc_id").isin(ids)).select("text").mapInArrow(tried, "rule string, took double, gone long")
    seen = {r["rule"]: (r["g"] / max(r["t"], 1e-9)) for r in rows.groupBy("rule").agg(F.sum("took").alias("t"), F.sum("gone").alias("g")).collect()}
    return sorted(rules, key=lambda r: -seen.get(r.name, 0.0))


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and rule: the first rule of the cascade that rejects (null if none)."""
    schema = "doc_id long, " + "".join(f"{k} long, " for k in BASE) + "base_failed boolean, kept boolean, rule string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch):
                m = measured(*c.text_bytes(part.column("text")))
                failed = base_failed(m)
                why = np.full(len(failed), None, object)
                left = np.flatnonzero(~failed)  # only texts that no earlier rule has rejected meet the next rule
                rest = m
                for rule in rules:
                    if not len(left):
                        break
                    # the texts that are left are cut out for measures that nothing has needed yet
                    if 2 * len(left) < len(rest.words.count) and not {rule.top, rule.bottom} <= rest.got.keys():
                        rest = m.only(left)
                    bad = rule.rejects(rest)
                    bad = bad if len(bad) == len(left) else bad[left]
                    why[left[bad]] = rule.name
                    left = left[~bad]
                    rest = m if len(rest.words.count) == len(failed) else rest.only(np.flatnonzero(~bad))
                kept = np.zeros(len(failed), bool)
                kept[left] = True
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), *(pa.array(m[k], pa.int64()) for k in BASE), pa.array(failed), pa.array(kept), pa.array(why, pa.string())], [x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the verdict of the cascade for every document. Which rule came first depends on measured time and is left out."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs, rank_rules(docs)).drop("rule")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^\n]', '', 'g')) + 1 AS n_lines,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]*[A-Za-z\x{80}-\x{10FFFF}][^\x20\x09-\x0D]*')) AS alpha_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS letters
  FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND n_symbols <= 0.1::DOUBLE * n_words
       AND n_dup_lines <= 0.5::DOUBLE * n_lines AND alpha_words >= 0.8::DOUBLE * n_words AND capitals <= 0.5::DOUBLE * letters AS kept
FROM b
"""
