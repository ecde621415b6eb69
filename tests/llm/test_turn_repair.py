"""Conversation repair against a search over all edits, and its SQL."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from readlake.llm import turn_repair as t

D = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns):
    """(conv_id -> digest columns) by plain recursion over turns and states. turns: (conv_id, turn, role, text), damaged already, None allowed; a role of None drops the row."""
    out = {}
    for conv in {x[0] for x in turns}:
        rows = [(x[1], x[2], x[3]) for x in turns if x[0] == conv and x[2] is not None]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))

        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

        @cache
        def best(i, state, inserts=0):
            found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
            if inserts < 4:
                for x in "ua":
                    if (state, x) in step and (rest := best(i, x, inserts + 1)):
                        found.append((3 + rest[0], "I" + rest[1], ({"u": "user:", "a": "assistant:"}[x], *rest[2])))
            if i < len(rows):
                _, role, text = rows[i]
                if rest := best(i + 1, state):
                    found.append((4 + rest[0], "D" + rest[1], rest[2]))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 if faults[i] == "truncated" else 0
                    if (state, role[:1]) in step and (rest := best(i + 1, role[:1])):
                        found.append((more + rest[0], "K" + rest[1], (f"{role}:{text}", *rest[2])))
                    for x, name in (("u", "user"), ("a", "assistant")):
                        if (state, x) in step and (rest := best(i + 1, x)):
                            found.append((3 + more + rest[0], "R" + rest[1], (f"{name}:{text}", *rest[2])))
            return min(found, default=None)

        cost, audit, lines = best(0, "")
        numbers = [r[0] for r in rows if r[0] is not None]
        initials = [r[1][:1] for r in rows]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert set(df.columns) == {"conv_id", *names}
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, None if kind == 0 else "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def random_rows(seed, convs=30):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None])
            text = rng.choice(["Yes.", "no", " ", None, "Why? ", "a long answer\n that ends.\t", "x" * 50 + "!", "  "])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), role, text))
    return rows


@pytest.mark.parametrize(("seed", "most_rows"), [(1, 4096), (2, 2), (3, 3)])
def test_equals_a_search_over_all_edits(spark, seed, most_rows):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(t.digests(t.repair(t.damage(df), most_rows=most_rows))) == brute(damaged(rows))


def test_long_conversation_is_cut_and_put_together_again(spark):
    """Most rows are of one conversation, with repeats over all partitions."""
    rng = random.Random(4)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"text {i}.", f"cut {i}", ""])) for i in range(160)] + random_rows(5, 5)
    df = spark.createDataFrame([r for r in rows if r[0] != 7 or r[1] is not None], SCHEMA).repartition(6)
    pieces = t.repair(df, most_rows=4, most_bytes=200)
    assert got(t.digests(pieces)) == brute([(a, b, " " if r is None else r, " " if x is None else x) for a, b, r, x in rows])
    parts = [r["parts"] for r in pieces.where("conv_id = 7 AND part = 0").collect()]
    assert parts and parts[0] > 30
    assert pieces.agg(F.max(F.size("turns"))).first()[0] <= 12  # four turns and what is inserted before them


def test_query_over_its_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(t.op11_turn_repair(spark, D)) == brute(damaged(rows))


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(t.digests(t.repair(t.damage(empty)))) == {}
    nothing = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(nothing, 0, "user", "x.", 1), (None, None, None, None, 2)], SCHEMA + ", cost int").withColumn("parts", F.lit("x"))
    found = got(t.digests(t.repair(t.damage(df))))
    void = hashlib.sha256(b"").hexdigest()
    assert found[nothing] == (0, 0, 0, 0, 0, 0, "", void)
    assert found[None] == brute(damaged([(None, None, None, None)]))[None]
    huge = spark.createDataFrame([(1, 0, "user", "word " * 400_000), (1, 1, "assistant", "Yes.")], SCHEMA)
    assert got(t.digests(t.repair(huge))) == brute([(1, 0, "user", "word " * 400_000), (1, 1, "assistant", "Yes.")])


def test_equal_rows_spread_over_tasks(spark):
    """A third of all rows may be one row."""
    rows = [(1, 0, "user", "Same.")] * 400 + [(k, 0, "user", "Other.") for k in range(2, 300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = got(t.digests(t.repair(df, most_rows=50)))
    assert found[1] == (0, 0, 399, 0, 399, 399 * 4 + 3, "K" + "D" * 399 + "I", hashlib.sha256(b"user:Same.\nassistant:").hexdigest())
    assert len(found) == 299


def test_product_is_associative():
    rng = random.Random(6)
    ms = [t.turn_matrix(rng.choice("suat"), rng.choice("bdtk")) for _ in range(40)]
    left = t.UNIT
    for m in ms:
        left = t.times(left, m)
    assert left == t.product(ms) == t.times(t.product(ms[:13]), t.product(ms[13:]))
