"""The index of decontamination: recall against brute force, how many candidates it lets through, and its shuffled way."""

import random

from pyspark.sql import functions as F

from readlake.llm import common, decontaminate
from test_operators import leaks_brute, prose, table


def edited(seed, text, edits):
    rng, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


ITEMS = [(k, prose(500 + k, 60 + k % 5, 3000)) for k in range(60)]
TEXTS = [prose(k, 30, 3000) + " " + edited(k, ITEMS[k % 60][1], k % 4) + " " + prose(600 + k, 20, 3000) for k in range(240)]


def test_recall_near_the_bound(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = leaks_brute(TEXTS, ITEMS)
    for rows in (decontaminate.BROADCAST_ROWS, 0):
        got = {}
        for r in decontaminate.matches(table(spark, TEXTS), bench, broadcast_rows=rows).collect():
            got.setdefault(r["doc_id"], set()).add(r["item_id"])
        assert all(sorted(got.get(i, ())) == x for i, x in want.items())
    assert sum(map(len, want.values())) >= 100 and any(not x for x in want.values())


def test_the_index_selects(spark):
    """Windows that share a shingle with an item meet few of the items of their length that they don't hold."""
    rng = random.Random(1)
    common_phrase = "this phrase is in everything here"
    items = [(k, prose(900 + k, 50, 3000) + " " + common_phrase) for k in range(120)]
    texts = [prose(2000 + k, 70, 3000) + " " + common_phrase + " " + prose(3000 + k, 30, 3000) for k in range(80)] + [items[rng.randrange(120)][1]]
    bench = spark.createDataFrame(items, "item_id long, text string").select("item_id", decontaminate.words(F.col("text")).alias("w")).withColumn("length", F.size("w"))
    found, pairs = decontaminate.candidates(table(spark, texts), common.cut(bench), 5, 10**6)
    n, met = found.count(), pairs.count()
    assert n >= 81 and 1 <= met < 0.3 * n * len(items)


def test_fingerprints_are_majorities_of_hash_bits(spark):
    rows = spark.createDataFrame([(1, prose(1, 9)), (2, prose(2, 400)), (3, "a b c d e " * 30)], "id long, t string").select("id", decontaminate.words(F.col("t")).alias("w"))
    got = decontaminate.with_print(rows, "w", 5, "print").withColumn("hashes", decontaminate.shingles("w", 5))
    got = got.withColumn("parts", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform("hashes", lambda h: F.xxhash64(i, h)))).collect()
    assert len(got) == 3
    for r in got:
        for part, hashes in zip(r["print"], r["parts"], strict=True):
            want = sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
            assert part % (1 << 64) == want


def test_rows_that_repeat_a_doc_id_or_have_none(spark):
    item = prose(77, 40)
    docs = spark.createDataFrame([(1, prose(1, 60)), (1, item), (1, prose(2, 10) + " " + " ".join(item.split()[:6])), (None, item), (None, "x"), (2, " \n")], "doc_id long, text string")
    got = decontaminate.flag(docs, spark.createDataFrame([(5, item), (None, item), (5, item)], "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["contaminated"], list(r["items"])) for r in got) == [("1", True, [5])] * 3 + [("2", False, [])] + [("None", True, [5])] * 2


def test_every_pair_within_the_radius_meets_once(spark):
    """Fingerprints that differ in 0 to 80 bits, spread evenly over the blocks or not, by all three plans of the index."""
    rng = random.Random(3)
    signed = lambda x: [((x >> 64 * i & (1 << 64) - 1) ^ 1 << 63) - (1 << 63) for i in range(4)]
    items = [(k, 10 + k % 2, rng.getrandbits(256)) for k in range(40)]
    asked = []
    for k in range(400):
        off, order = k % 81, [8 * (b % 32) + b // 32 for b in range(256)] if k % 3 else rng.sample(range(256), 256)
        asked.append((k, items[k % 40][1], items[k % 40][2] ^ sum(1 << b for b in order[:off])))
    want = sorted((a, i) for a, la, x in asked for i, li, y in items if la == li and (x ^ y).bit_count() <= decontaminate.RADIUS)
    windows = spark.createDataFrame([(k, n, signed(x)) for k, n, x in asked], "window long, length int, print array<long>")
    own = spark.createDataFrame([(k, n, signed(x)) for k, n, x in items], "item_hash long, length int, item_print array<long>")
    assert len(want) >= 300
    for rows in (10**6, 40 * 32, 0):
        assert sorted(map(tuple, decontaminate.met(windows, own, 40, rows).collect())) == want


def test_what_goes_through_the_index_is_narrow(spark):
    windows = spark.createDataFrame([(1, 10, [0] * 4)], "window long, length int, print array<long>")
    assert decontaminate.with_keys(windows, "print", 0).count() == 32 and decontaminate.with_keys(windows, "print", 1).count() == 288
