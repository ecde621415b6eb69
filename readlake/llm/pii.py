"""Personal data by bootstrapped contextual extraction.

One pass over the whole texts finds the base entities (email, ip, card, phone) and every other string of the shape of an
identifier, each with its lexical patterns: the word before it, and the two words before it. Base entities, and long
hexadecimal strings, are seeds. Spark then scores the graph of patterns and instances: a pattern's confidence is the mean score of
its distinct instances, shrunk by one doubtful instance; an instance's score is the chance that one of its patterns is right;
seeds stay at 1. After `rounds` rounds, patterns with enough distinct instances and confidence mark all their instances, seen or
not, as kind "id".

A second pass counts what else stands after trusted patterns: a pattern is open if strings of the shape of an identifier are at least
`confidence` of its distinct fillers, shrunk in the same way, so that "token =" is and "the" is not. The first pass knows the strings of that
shape that may stand after a pattern, and so how many others close it for certain: patterns that nothing can open are not looked for, and a
worker that has met one more than a pattern may have looks for it no longer. A third pass marks every filler of
open patterns, whatever its shape: a string of letters, or of one digit. Workers hold at most PATTERNS patterns at a time; where more are
trusted or open, groups of them by hash take a pass each. Only candidates and patterns are shuffled, never texts.

Base kinds, leftmost and non-overlapping per kind, failing matches dropped without retries: see the patterns below.
Starts and ends count code points, ends exclusive. Defined results: null and empty texts have no spans. Rows that repeat a doc_id
are each read on their own. An identifier that overlaps a base span is not one of kind "id". Other columns are left alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Set
from functools import reduce
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import common as c

KINDS = ("email", "ip", "card", "phone", "id")

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails at the first digit of a run fails at all of them, so only first digits are tried
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IDENT = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._/+-]*[A-Za-z0-9])?")
_HEX = re.compile(r"[0-9a-f]{32,}\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CONTEXT = 96
_FILLER = re.compile(r"[^\W_](?:[\w.+/-]*[^\W_])?")
_WORD, _OPENING, _EDGE = re.compile(r"\S+"), "\"'([{<", re.compile(r"[\"'(\[{<]+")
LEAST, DIGITS, PATTERNS, HELD = 6, 2, 262_144, 1_000_000


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """What [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ finds, in time linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        end = at
        if (m := _AT.match(text, at)) and at > last and text[at - 1] in _LOCAL_CHARS:
            begin = at
            while begin > last and text[begin - 1] in _LOCAL_CHARS:
                begin -= 1
            end = last = m.end()
            out.append((begin, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    if not text:
        return []
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= x <= "9" for x in m[0]) <= 15]
    return [(a, b, KINDS[k]) for a, k, b in sorted((a, k, b) for k, a, b in found)]


def _patterns(text: str, start: int) -> list[str]:
    left = text[max(0, start - _CONTEXT) : start].rstrip(_OPENING).lower().split()[-2:]
    return [" ".join(left[-n:]) for n in (1, 2) if len(left) >= n]


def _apart(base: list[tuple[int, int, str]]) -> Callable[[int, int], bool]:
    """Whether a span overlaps none of these, which are in order of their starts."""
    starts, ends = [a for a, _, _ in base], [0, *accumulate((b for _, b, _ in base), max)]
    return lambda a, b: ends[bisect_left(starts, b)] <= a


def candidates(text: str | None, base: list[tuple[int, int, str]], least: int = LEAST, digits: int = DIGITS) -> list[tuple[int, int, str, bool, bool, list[str]]]:
    """(start, end, instance, seed, base, patterns) of base spans and of strings of the shape of an identifier."""
    if not text or not (base or _DIGIT.search(text)):
        return []
    out = [(a, b, text[a:b], True, True, _patterns(text, a)) for a, b, _ in base]
    apart = _apart(base)
    for m in _IDENT.finditer(text):
        a, b = m.span()
        if b - a >= least and sum("0" <= x <= "9" for x in m[0]) >= digits and apart(a, b):
            out.append((a, b, m[0], bool(_HEX.match(m[0])), False, _patterns(text, a)))
    return out


def _is_shaped(x: str) -> bool:
    return len(x) >= LEAST and sum("0" <= c <= "9" for c in x) >= DIGITS


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def shaped(text: str | None, base: list[tuple[int, int, str]]) -> set[tuple[str, int]]:
    """(pattern, hash) of all strings of the shape of an identifier that may be fillers, and of some others."""
    if not text or not _DIGIT.search(text):
        return set()
    apart = _apart(base)
    spans = [m.span() for m in _FILLER.finditer(text) if _is_shaped(m[0]) and apart(*m.span())]
    return {(p, _hash(text[a:b])) for a, b in spans for p in _patterns(text, a)}


class Fillers:
    """Finds what stands right after one of some patterns, as _patterns() gives them, but for what overlaps base spans.

    A filler begins a word, or follows quotes or brackets inside of it, as in key="value".
    """

    def __init__(self, patterns: Set[str]):
        self.patterns, self.ending = set(patterns), Counter(p.rsplit(" ", 1)[-1] for p in patterns)
        self.last = set(self.ending)

    def drop(self, pattern: str) -> None:
        """From now on that is none of the patterns."""
        self.patterns.remove(pattern)
        last = pattern.rsplit(" ", 1)[-1]
        self.ending[last] -= 1
        if not self.ending[last]:
            self.last.remove(last)

    def _ends(self, left: str) -> bool:
        """Whether a pattern may end with that; a very long word is cut by _patterns()."""
        return left in self.last or len(left) > _CONTEXT - 8

    def _may(self, word: str) -> bool:
        return self._ends(word) or any(self._ends(word[: m.start()]) for m in _EDGE.finditer(word))

    def of(self, text: str | None) -> list[tuple[str, int, int]]:
        """(pattern, start, end)"""
        words = set((text or "").lower().split())
        # only words with other characters than letters and digits, and very long ones, may end in the middle
        if self.last.isdisjoint(words) and not any(self._may(w) for w in words if not w.isalnum() or len(w) > _CONTEXT - 8):
            return []
        begins, before = [], ""
        for w in _WORD.finditer(text):
            a, word = w.start(), w[0]
            if self._ends(before):
                begins.append(a + len(word) - len(word.lstrip(_OPENING)))
            begins += [a + m.end() for m in _EDGE.finditer(word) if m.start() and self._ends(word[: m.start()].lower())]
            before = word.lower()
        spans = [m.span() for x in begins if (m := _FILLER.match(text, x))]
        found = [(p, a, b) for a, b in spans for p in _patterns(text, a) if p in self.patterns]
        apart = _apart(base_spans(text)) if found else None
        return [x for x in found if apart(x[1], x[2])]


def _in_groups(patterns: DataFrame) -> Iterator[dict[str, int | None]]:
    """All patterns, about PATTERNS at a time, with their limits as far as there are any."""
    groups = patterns.count() // PATTERNS + 1
    for g in range(groups):
        part = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == g) if groups > 1 else patterns
        if some := {r["pattern"]: r["most"] if "most" in r else None for r in part.collect()}:
            yield some


def may_open(trusted: DataFrame, near: DataFrame, confidence: float = 0.7) -> DataFrame:
    """(pattern, most): the trusted patterns that may be open, and how many other fillers one may have. near: pattern, i of all that shaped() finds.

    With n strings of the shape at most, of which a pattern has n / (n + others + 1) at most, one other more than `most` closes it.
    """
    n = near.join(trusted, "pattern").groupBy("pattern").agg(F.count_distinct("i").alias("n")).where(F.col("n") >= confidence * (F.col("n") + 1) - 1e-9)
    return n.select("pattern", (F.floor(F.col("n") * (1 / confidence - 1)) + 1).alias("most"))


def open_patterns(docs: DataFrame, trusted: DataFrame, confidence: float = 0.7) -> DataFrame:
    """(pattern): the trusted patterns whose fillers are identifiers as a rule. trusted: pattern, and most, if that is known."""

    def counted(some: dict[str, int | None]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, others, held = Fillers(some.keys()), defaultdict(set), 0
            for batch in batches:
                for part in c.slices(batch):
                    seen = set()
                    for text in part.column("text").to_pylist():
                        for p, a, b in find.of(text):
                            i, like = _hash(text[a:b]), _is_shaped(text[a:b])
                            seen.add((p, i, like))
                            if like or some[p] is None or p not in find.patterns or i in others[p]:
                                continue
                            others[p].add(i)
                            held += 1
                            if len(others[p]) > some[p]:
                                # closed by what is passed on
                                held -= len(others.pop(p))
                                find.drop(p)
                    if held > HELD:
                        others.clear()
                        held = 0
                    yield pa.record_batch([pa.array([x[0] for x in seen], pa.string()), pa.array([x[1] for x in seen], pa.int64()), pa.array([x[2] for x in seen], pa.bool_())], ["pattern", "i", "shaped"])

        found = docs.select("text").mapInArrow(run, "pattern string, i long, shaped boolean").groupBy("pattern", "i").agg(F.max("shaped").alias("shaped"))
        share = F.sum(F.col("shaped").cast("double")) / (F.count("*") + 1)
        return found.groupBy("pattern").agg(share.alias("share")).where(F.col("share") >= confidence).select("pattern")

    parts = [counted(some) for some in _in_groups(trusted)]
    return c.cut(reduce(DataFrame.unionByName, parts)) if parts else trusted.select("pattern")


def open_marks(docs: DataFrame, patterns: DataFrame) -> DataFrame | None:
    """(doc_id, text_hash, start, end): all fillers of the patterns; None if there are no patterns."""

    def marked(some: dict[str, int | None]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = Fillers(some.keys())
            for batch in batches:
                for part in c.slices(batch):
                    found, at = [], []
                    for i, text in enumerate(part.column("text").to_pylist()):
                        spots = {(a, b) for _, a, b in find.of(text)}
                        found += spots
                        at += [i] * len(spots)
                    ids = [part.column(k).cast(pa.int64()).take(pa.array(at, pa.int64())) for k in ("doc_id", "text_hash")]
                    yield pa.record_batch([*ids, pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32())], ["doc_id", "text_hash", "start", "end"])

        return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, start int, end int")

    parts = [marked(some) for some in _in_groups(patterns)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, base, found and near (what may open patterns) of every row of docs: one pass over the texts."""
    span = "array<struct<start: int, end: int, kind: string>>"
    schema = f"row long, doc_id long, text_hash long, base {span}, found array<struct<start: int, end: int, instance: string, seed: boolean, base: boolean, patterns: array<string>>>, near array<struct<pattern: string, i: long>>"
    t_base = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    t_found = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("seed", pa.bool_()), ("base", pa.bool_()), ("patterns", pa.list_(pa.string()))]))
    t_near = pa.list_(pa.struct([("pattern", pa.string()), ("i", pa.int64())]))
    names = [f.name for f in t_found.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in c.slices(batch):
                base, found, near = [], [], []
                for text in part.column("text").to_pylist():
                    spans = base_spans(text)
                    base.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
                    found.append([dict(zip(names, x, strict=True)) for x in candidates(text, spans)])
                    near.append([{"pattern": p, "i": i} for p, i in shaped(text, spans)])
                ids = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.record_batch([ids, part.column("doc_id").cast(pa.int64()), part.column("text_hash"), pa.array(base, t_base), pa.array(found, t_found), pa.array(near, t_near)], ["row", "doc_id", "text_hash", "base", "found", "near"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def trusted_patterns(found: DataFrame, rounds: int = 3, least_instances: int = 3, confidence: float = 0.7) -> DataFrame:
    """(pattern): those that the scored graph trusts. found: instance, seed, patterns of every candidate."""
    edges = found.select(F.xxhash64("instance").alias("i"), "seed", F.explode("patterns").alias("pattern"))
    edges = c.cut(edges.groupBy("pattern", "i").agg(F.max("seed").alias("seed")))
    scored = edges.select("pattern", "i", "seed", F.col("seed").cast("double").alias("score"))
    for left in range(rounds, 0, -1):
        # one doubtful instance more than there are
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("conf"), F.count("*").alias("n"))
        patterns = patterns.where((F.col("n") >= least_instances) & (F.col("conf") >= confidence / 2))
        if left == 1:
            return patterns.where(F.col("conf") >= confidence).select("pattern")
        doubt = edges.join(patterns, "pattern").groupBy("i").agg(F.exp(F.sum(F.ln(1 - F.least(F.col("conf"), F.lit(0.99))))).alias("doubt"))
        score = F.when(F.col("seed"), 1.0).otherwise(1 - F.coalesce("doubt", F.lit(1.0)))
        scored = c.cut(edges.join(doubt, "i", "left").select("pattern", "i", "seed", score.alias("score")))
    raise ValueError("rounds must be 1 or more")


def find_private(docs: DataFrame, rounds: int = 3, least_instances: int = 3, confidence: float = 0.7) -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind, by start, then kind as listed) of every row of docs."""
    seen = c.cut(scan(docs))
    found = seen.select("row", F.explode("found").alias("f")).select("row", "f.*")
    trusted = trusted_patterns(found, rounds, least_instances, confidence)
    others = found.where(~F.col("base"))
    by_pattern = others.select("row", "start", "end", F.explode("patterns").alias("pattern")).join(trusted, "pattern").select("row", "start", "end")
    extra = by_pattern.unionByName(others.where("seed").select("row", "start", "end"))
    near = seen.select(F.explode("near").alias("n")).select("n.*")
    marks = open_marks(docs, open_patterns(docs, c.cut(may_open(trusted, near, confidence)), confidence))
    if marks is not None:
        # by what the row holds, not by its place, which another run of docs may change
        marks = marks.select(F.col("doc_id").alias("of"), "text_hash", "start", "end").distinct()
        rows = seen.select("row", "doc_id", F.col("text_hash").alias("own_hash"))
        extra = extra.unionByName(rows.join(marks, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("own_hash") == F.col("text_hash"))).select("row", "start", "end"))
    extra = extra.groupBy("row").agg(F.collect_set(F.struct(F.col("start"), F.col("end"), F.lit("id").alias("kind"))).alias("extra"))
    spans = F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start: int, end: int, kind: string>>")))
    ranks = F.array(*map(F.lit, KINDS))
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(ranks, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return seen.join(extra, "row", "left").select("doc_id", "base", F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    found = find_private(c.table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:4]), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
