"""Repair of conversation structure by a min-plus scan of 4x4 matrices.

The roles of a repaired conversation read `(s?(ua)+)?`: an automaton of four states, nothing yet, after s, after u, after a. A turn is the
matrix of what its cheapest edit makes of each state, an element being (cost, audit), the lesser one by cost and then by audit; before the
edit stands the closure of inserts, which is a matrix too. Products of these matrices are associative, so a conversation can be cut anywhere.

Turns are sorted over all partitions by conversation and turn, which cuts a conversation of any size into runs. A task folds each
conversation that begins and ends in one run of at most MOST_ROWS turns and MOST_BYTES of text. The others (the first and the last of each partition, and long
ones) leave segments: their matrices are reduced by a tree, FAN to one at each level, the audit of the root is cut at the segments, and each
segment edits its own turns. A turn that repeats role and text is found in the task, and between the partitions of a conversation by
one aggregate over the 128-bit hashes of its first occurrences in each.

Equal costs go to the least audit; an audit fixes the result, as the number of turns left tells the role of each place.

Defined results: a null role or text is one space, so that the turn is blank; a null turn comes first; turns of equal number are ordered by role
and then by MD5 of the text; repeated rows are duplicates. A null conv_id is a conversation. A conversation without turns has zeros, an empty
audit and no turns left. Other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readlake.llm import common as c

MOST_ROWS, MOST_BYTES, FAN = 4096, 8 << 20, 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

START, S, U, A = range(4)
INFINITE = (1 << 60, "")
Matrix = list[list[tuple[int, str]]]

_SOLID = re.compile(r"[^\x20\x09-\x0D]")
_ROLES = {"u": "user", "a": "assistant"}
#: the state after a turn of that role, by the state before it
_AFTER = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}


def _matrix(entries: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return [[entries.get((i, j), INFINITE) for j in range(4)] for i in range(4)]


def times(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product; left may be a single row."""
    out = []
    for row in left:
        live = [(k, cost, audit) for k, (cost, audit) in enumerate(row) if cost < INFINITE[0]]
        out.append([min(((cost + right[k][j][0], audit + right[k][j][1]) for k, cost, audit in live if right[k][j][0] < INFINITE[0]), default=INFINITE) for j in range(4)])
    return out


UNIT = _matrix({(i, i): (0, "") for i in range(4)})
_ONE_INSERT = _matrix({(i, i): (0, "") for i in range(4)} | {(i, j): (INSERT, "I") for by in ("u", "a") for i, j in _AFTER[by].items()})
CLOSURE = times(_ONE_INSERT, _ONE_INSERT)  # a third insert never helps: two lead to any state that has a way


def _edits(role: str, fault: str) -> Matrix:
    found = {(i, i): (DELETE, "D") for i in range(4)}
    if fault in "bd":
        return _matrix(found)
    more = TRUNCATED if fault == "t" else 0
    for by in ("u", "a"):
        found |= {(i, j): (REROLE + more, "R") for i, j in _AFTER[by].items()}
    return _matrix(found | {(i, j): (KEEP + more, "K") for i, j in _AFTER.get(role, {}).items()})


_TURNS: dict[tuple[str, str], Matrix] = {(role, fault): times(CLOSURE, _edits(role, fault)) for role in ("s", "u", "a", "") for fault in "bdtk"}


def turn_matrix(role: str, fault: str) -> Matrix:
    """Inserts, then the edit of a turn. role: its initial; fault: b blank, d duplicate, t truncated, k none."""
    return _TURNS[role if role in _AFTER else "", fault]


def product(matrices: list[Matrix]) -> Matrix:
    """Halves first, so that audits are copied a logarithmic number of times."""
    if len(matrices) <= 2:
        return reduce(times, matrices, UNIT) if len(matrices) < 2 else times(*matrices)
    half = len(matrices) // 2
    return times(product(matrices[:half]), product(matrices[half:]))


def best(row: list[tuple[int, str]]) -> tuple[int, str]:
    """Of a row of states after the last turn: inserts at the end, then the cheapest of the states in which a conversation may end."""
    end = times([row], CLOSURE)[0]
    return min(end[START], end[A])


def edited(turns: Iterable[tuple[str, str]], audit: str, at: int, odd: bool) -> list[dict[str, str]]:
    """The turns that an audit leaves; at: how many stand before them; odd: whether the whole has an odd number of turns."""
    out, rest = [], iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit != "K":
            role = _ROLES["u" if (at % 2 == 0) != odd else "a"]
        out.append({"role": role, "text": text})
        at += 1
    return out


def _left(audit: str) -> int:
    return len(audit) - audit.count("D")


_LEGAL = {"su", "ua", "au"}
_TURN = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_COUNTS = "n long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, n_turns long, first_turn long, last_turn long"


def _schema(conv: T.DataType, more: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL(more).fields])


class _Segment:
    """Turns of one conversation that follow each other in one task."""

    def __init__(self) -> None:
        self.turns, self.kinds, self.fresh, self.numbers, self.bytes = [], [], [], [], 0

    def counts(self) -> dict:
        known = [x for x in self.numbers if x is not None]  # in order
        initials = [role[:1] for role, _ in self.turns]
        return {
            "n": len(self.turns), "blank": self.kinds.count("b"), "duplicate": self.kinds.count("d"), "truncated": self.kinds.count("t"),
            "illegal": sum(a + b not in _LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True)), "first_role": initials[0] if initials else None, "last_role": initials[-1] if initials else None,
            "n_turns": len(set(known)), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
        }


def _runs(most_rows: int, most_bytes: int, schema: T.StructType):
    """Folds the conversations that end in the task; leaves segments of the others."""
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, made, out, size = TaskContext.get().partitionId(), 0, [], 0
        open_, conv, seen, first, cut = None, None, set(), True, False

        def close(ended: bool) -> None:
            """The segment is done; `ended` if its conversation is known to be."""
            nonlocal made, size, open_
            whole = ended and not first and not cut
            row = {"conv_id": conv, "pid": pid, "k": made, "whole": whole, **open_.counts()}
            if whole:
                row["cost"], row["audit"] = best(reduce(times, (turn_matrix(r[:1], k) for (r, _), k in zip(open_.turns, open_.kinds, strict=True)), [UNIT[START]])[0])
                row["turns"] = edited(open_.turns, row["audit"], 0, _left(row["audit"]) % 2 == 1)
            else:
                row |= {"turns": [{"role": r, "text": t} for r, t in open_.turns], "kinds": "".join(open_.kinds), "fresh": open_.fresh}
            out.append(row)
            made, size, open_ = made + 1, size + open_.bytes, _Segment()

        for batch in batches:
            for r in batch.to_pylist():
                if open_ is None or r["conv_id"] != conv:
                    if open_ is not None:
                        close(True)
                        first = False
                    open_, conv, seen, cut = _Segment(), r["conv_id"], set(), False
                for _ in range(r["copies"]):
                    role, text = r["role"], r["text"]
                    if len(open_.turns) >= most_rows or open_.turns and open_.bytes + len(text) > most_bytes:
                        close(False)
                        cut = True
                    solid = text.rstrip(c.SPACES)
                    kind = "t" if solid[-1:] not in (".", "!", "?") else "k"
                    if not _SOLID.search(text):
                        kind = "b"
                    else:
                        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                        if mark in seen:
                            kind = "d"
                        else:
                            seen.add(mark)
                            open_.fresh.append({"pos": len(open_.turns), "mark": mark})
                    open_.turns.append((role, text))
                    open_.kinds.append(kind)
                    open_.numbers.append(r["turn"])
                    open_.bytes += len(text)
                if size > most_bytes or len(out) > most_rows:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, size = [], 0
        if open_ is not None:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _reduced(segments: DataFrame, conv: T.DataType) -> DataFrame:
    """(conv_id, cost, audit) of conversations in segments: conv_id, idx, and cost and audit of 16 elements, by a tree of products."""
    schema = _schema(conv, "idx long, costs array<long>, audits array<string>")
    arrow = _arrow(schema)

    def level(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["idx"])
        made = product([_unpacked(r) for r in rows])
        return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"], "idx": rows[0]["idx"] // FAN, **_packed(made)}], arrow)

    deepest = segments.agg(F.max("idx")).first()[0] or 0
    while True:
        segments = segments.select("conv_id", "idx", "costs", "audits").groupBy("conv_id", F.expr(f"idx div {FAN}")).applyInArrow(lambda key, t: level(t), schema)
        if not (deepest := deepest // FAN):
            break

    ended = _schema(conv, "cost long, audit string")
    names = _arrow(ended)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["conv_id"], *best(_unpacked(r)[START])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(names.names, r, strict=True)) for r in rows], names)

    return segments.mapInArrow(end, ended)


def _packed(m: Matrix) -> dict:
    return {"costs": [x[0] for row in m for x in row], "audits": [x[1] for row in m for x in row]}


def _unpacked(r: dict) -> Matrix:
    flat = [*zip(r["costs"], r["audits"], strict=True)]
    return [flat[4 * i : 4 * i + 4] for i in range(4)]


def _cut_audit(audit: str, rows: list[int]) -> list[str]:
    """The edits of each of the segments that follow each other; those at the end go to the last."""
    on_turn = np.flatnonzero(np.frombuffer(audit.encode(), np.uint8) != ord("I"))
    ends = [0 if not n else int(on_turn[n - 1]) + 1 for n in np.cumsum(rows).tolist()]
    ends[-1] = len(audit)
    return [audit[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _joined(open_: DataFrame, conv: T.DataType) -> DataFrame:
    """Pieces of the conversations that lie in segments."""
    at = F.posexplode("fresh").alias("_", "f")
    fresh = open_.select("conv_id", "pid", "k", at).select("conv_id", "f.mark", F.struct("pid", "k", "f.pos").alias("at"))
    # a mark occurs once in each partition of its conversation, so that the lists are bounded by the number of partitions
    again = fresh.groupBy("conv_id", "mark").agg(F.sort_array(F.collect_list("at")).alias("at")).where(F.size("at") > 1)
    again = again.select("conv_id", F.explode(F.slice("at", F.lit(2), F.size("at") - 1)).alias("at")).groupBy("conv_id", "at.pid", "at.k").agg(F.collect_list("at.pos").alias("repeats"))
    same = [F.col("conv_id").eqNullSafe(F.col("again_conv")), F.col("pid") == F.col("again_pid"), F.col("k") == F.col("again_k")]
    initials = F.transform("turns", lambda t: F.substring(t["role"], 1, 1))
    rows = open_.withColumn("initials", initials).drop("turns", "fresh", "whole", "cost", "audit").join(again.toDF("again_conv", "again_pid", "again_k", "repeats"), same, "left").drop("again_conv", "again_pid", "again_k")
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("pid", "k")).cast("long") - 1
    rows = rows.withColumn("idx", idx)
    schema = _schema(conv, f"pid int, k long, idx long, {_COUNTS}, costs array<long>, audits array<string>")
    arrow = _arrow(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kinds = list(r.pop("kinds"))
                for pos in r.pop("repeats") or ():
                    r["truncated"] -= kinds[pos] == "t"
                    r["duplicate"] += 1
                    kinds[pos] = "d"
                made = product([turn_matrix(role, kind) for role, kind in zip(r.pop("initials"), kinds, strict=True)])
                yield pa.RecordBatch.from_pylist([{n: v for n, v in (r | _packed(made)).items() if n in arrow.names}], arrow)

    ours = [F.col("conv_id").eqNullSafe(F.col("of_conv_id")), F.col("pid") == F.col("of_pid"), F.col("k") == F.col("of_k")]
    scanned = c.cut(rows.mapInArrow(scan, schema))
    roots = _reduced(scanned, conv)

    pieces = _schema(conv, "pid int, k long, part long, parts long, edits string, at long, odd boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    names = _arrow(pieces)

    def spread(_, segments: pa.Table, root: pa.Table) -> pa.Table:
        rows = sorted(segments.to_pylist(), key=lambda r: r["idx"])
        root = root.to_pylist()[0]
        at, out, odd = 0, [], _left(root["audit"]) % 2 == 1
        for r, edits in zip(rows, _cut_audit(root["audit"], [r["n"] for r in rows]), strict=True):
            out.append({"conv_id": r["conv_id"], "pid": r["pid"], "k": r["k"], "part": r["idx"], "parts": len(rows), "edits": edits, "at": at, "odd": odd})
            at += _left(edits)
        full = [r for r in rows if r["n"]]
        known = [r for r in full if r["n_turns"]]
        beside = sum(a["last_role"] + b["first_role"] not in _LEGAL for a, b in zip(full[:-1], full[1:], strict=True))
        distinct = sum(r["n_turns"] for r in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known[:-1], known[1:], strict=True))
        out[0] |= {n: sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated", "illegal")}
        out[0] |= {"illegal": out[0]["illegal"] + beside, "gaps": known[-1]["last_turn"] - known[0]["first_turn"] + 1 - distinct if known else 0, "cost": root["cost"], "audit": root["audit"]}
        return pa.Table.from_pylist(out, names)

    light = scanned.drop("costs", "audits")
    cuts = light.groupBy("conv_id").cogroup(roots.groupBy("conv_id")).applyInArrow(spread, pieces)
    turns = open_.select(*(F.col(n).alias(f"of_{n}") for n in ("conv_id", "pid", "k")), "turns")
    done = T.StructType([*_pieces(conv).fields])
    made = _arrow(done)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                r["turns"] = edited([(t["role"], t["text"]) for t in r["turns"]], r["edits"], r["at"], r["odd"])
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in made.names}], made)

    return cuts.join(turns, ours).mapInArrow(edit, done)


def _pieces(conv: T.DataType) -> T.StructType:
    out = _schema(conv, "part long, parts long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return out.add("turns", _TURN)


def repair(turns: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Every conversation in pieces: conv_id, part, parts, turns (role, text; those left, of this piece), and at part 0 also
    gaps, blank, duplicate, truncated, illegal, cost and audit of the whole.

    turns: conv_id, turn, role, text, and, if there, copies (how often the row stands, 1) and gone (the row only names its conversation).
    """
    conv = turns.schema["conv_id"].dataType
    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.when(gone, 0).otherwise(copies).alias("copies"))
    rows = rows.withColumns({"mark": F.md5("text"), "row": F.monotonically_increasing_id()})
    # equal rows may lie on both sides of a bound; their order does not matter
    dealt = rows.repartitionByRange("conv_id", "turn", "role", "mark", "row").sortWithinPartitions("conv_id", "turn", "role", "mark").drop("mark", "row")
    schema = _schema(conv, f"pid int, k long, whole boolean, {_COUNTS}, cost long, audit string, kinds string, fresh array<struct<pos: int, mark: binary>>").add("turns", _TURN)
    found = c.cut(dealt.mapInArrow(_runs(most_rows, most_bytes, schema), schema))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0))
    whole = found.where("whole").select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("parts"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns")
    return whole.unionByName(_joined(found.where("not whole"), conv))


def damage(turns: DataFrame) -> DataFrame:
    """What crc32(conv_id:turn) % 20 says: 0 drops the row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 sets its role to user. Nulls are one space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"), (kind == 0).alias("gone"))


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `role:text` lines. Conversations of several pieces are hashed piece by piece, in order."""
    text = F.when(F.size("turns") > 0, F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))
    pieces = pieces.withColumn("lines", text)
    one = pieces.where("parts = 1").withColumn("repaired_sha256", F.sha2(F.coalesce("lines", F.lit("")), 256))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    many = pieces.where("parts > 1").select("conv_id", "part", *numbers, "lines")
    schema = T.StructType([*many.drop("part", "lines").schema.fields, T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state, empty = None, None, True
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] == 0:
                    if row:
                        yield pa.RecordBatch.from_pylist([row | {"repaired_sha256": state.hexdigest()}], arrow)
                    row, state, empty = {n: r[n] for n in arrow.names[:-1]}, hashlib.sha256(), True
                if r["lines"] is not None:
                    state.update(("" if empty else "\n").encode() + r["lines"].encode())
                    empty = False
        if row:
            yield pa.RecordBatch.from_pylist([row | {"repaired_sha256": state.hexdigest()}], arrow)

    hashed = many.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)
    return one.select(*schema.names).unionByName(hashed)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after damage."""
    return digests(repair(damage(c.table(spark, sf_dir, "conversations"))))


#: crc32 bit by bit; the scan is a recursion over turns, with the edits of each state joined to it and the least kept.
ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
         lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))),
         4294967295::BIGINT) % 20 AS kind FROM keyed),
turns AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, LATERAL (SELECT unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END))) copies WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM turns),
counted_again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
faults AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'k' END AS fault FROM counted_again),
closure(of_, to_, cost, audit, lines) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']),
  (3, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
edits(of_, to_, cost, edit, initial, role) AS (VALUES
  (0, 0, 4, 'D', NULL, NULL), (1, 1, 4, 'D', NULL, NULL), (2, 2, 4, 'D', NULL, NULL), (3, 3, 4, 'D', NULL, NULL), (0, 1, 0, 'K', 's', NULL),
  (0, 2, 0, 'K', 'u', NULL), (1, 2, 0, 'K', 'u', NULL), (3, 2, 0, 'K', 'u', NULL), (2, 3, 0, 'K', 'a', NULL),
  (0, 2, 3, 'R', NULL, 'user'), (1, 2, 3, 'R', NULL, 'user'), (3, 2, 3, 'R', NULL, 'user'), (2, 3, 3, 'R', NULL, 'assistant')),
scan(conv_id, i, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM conversations
  UNION ALL
  SELECT s.conv_id, f.i, e.to_, min({'cost': s.best.cost + c.cost + e.cost + CASE WHEN f.fault = 't' AND e.edit <> 'D' THEN 3 ELSE 0 END,
         'audit': s.best.audit || c.audit || e.edit,
         'lines': list_concat(s.best.lines, c.lines, CASE e.edit WHEN 'D' THEN []::VARCHAR[] ELSE [coalesce(e.role, f.role) || ':' || f.text] END)})
  FROM scan s JOIN closure c ON c.of_ = s.state JOIN edits e ON e.of_ = c.to_ JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1
  WHERE e.edit = 'D' OR (f.fault NOT IN ('b', 'd') AND (e.edit = 'R' OR e.initial = f.initial))
  GROUP BY s.conv_id, f.i, e.to_),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b')::BIGINT AS blank,
         count(*) FILTER (fault = 'd')::BIGINT AS duplicate, count(*) FILTER (fault = 't')::BIGINT AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM faults GROUP BY conv_id),
done AS (
  SELECT s.conv_id, min({'cost': s.best.cost + c.cost, 'audit': s.best.audit || c.audit, 'lines': list_concat(s.best.lines, c.lines)}) AS best
  FROM scan s JOIN closure c ON c.of_ = s.state LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM s.conv_id
  WHERE s.i = coalesce(n.n, 0) AND c.to_ IN (0, 3) GROUP BY s.conv_id)
SELECT d.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated,
       coalesce(n.illegal, 0) AS illegal, d.best.cost::BIGINT AS cost, d.best.audit AS audit, sha256(coalesce(array_to_string(d.best.lines, chr(10)), '')) AS repaired_sha256
FROM done d LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM d.conv_id
"""
