"""Lexical search against plain counting, the arithmetic on bitmaps against numbers, edges and groups of items."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake.llm import lexical_search as x

D = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=50):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, tf) for i, tf in docs if tf]
    n_docs, total = len(docs), sum(sum(tf.values()) for _, tf in docs)
    df = Counter(t for _, tf in docs for t in tf)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for i, tf in docs:
            m = 50 + 50 * sum(tf.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in words if t in tf)
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本", "x1"]
    pick = lambda k: " ,".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=k))
    docs = [(i, pick(rng.randint(1, 40))) for i in range(n)]
    items = [(i, pick(rng.randint(1, 12)).upper()) for i in range(12)]
    return docs, items


@pytest.mark.parametrize(("block", "group_terms"), [(1 << 14, 1 << 18), (70, 1 << 18), (64, 20)])
def test_equals_plain_counting(spark, block, group_terms):
    """In large and small blocks, and with items in several groups."""
    docs, items = corpus(500)
    docs += [(7, docs[3][1]), (7, docs[3][1]), (None, docs[3][1]), (900, None), (901, " ;"), (902, "")]
    found = x.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), 50, block, group_terms)
    assert got(found) == brute(docs, items)


def test_ties_go_to_the_smallest_ids(spark):
    docs = [(i, "same words here") for i in range(400, 0, -1)] + [(1000 + i, f"other {i}") for i in range(300)]
    items = [(1, "same here"), (2, "other"), (3, "absent"), (4, None), (None, "words"), (5, "Same"), (5, "HERE")]
    found = got(x.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), spark.createDataFrame(items, "item_id long, text string")))
    assert found == brute(docs, items)
    assert [r[2] for r in sorted(found, key=lambda r: r[1]) if r[0] == 1] == [*range(1, 51)]


def test_edges(spark):
    none_d, none_i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id int, text string")
    docs = spark.createDataFrame([(1, "word " * 300_000 + "last", 3), (2, "last", 4)], "doc_id long, text string, rank int").withColumn("item", F.lit("x"))
    items = spark.createDataFrame([(1, "LAST word", 0)], "item_id int, text string, score int")
    assert got(x.rank(none_d, items)) == got(x.rank(docs, none_i)) == got(x.rank(none_d, none_i)) == []
    found = x.rank(docs, items)
    assert got(found) == brute([(1, "word " * 300_000 + "last"), (2, "last")], [(1, "last word")])
    assert found.schema["item_id"].dataType.simpleString() == "int"


def test_added_bitmaps_are_sums():
    rng = np.random.default_rng(2)
    numbers = rng.integers(0, 1 << 33, (40, 128))
    sliced = [np.packbits(((row[None, :] >> np.arange(39)[:, None]) & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for row in numbers]
    sums = numbers.sum(axis=0)
    places, scores = x.top(x.add(sliced), 128)
    assert dict(zip(places.tolist(), scores.tolist())) == dict(enumerate(sums.tolist()))
    for k in (1, 5, 50):
        places, scores = x.top(x.add(sliced), k)
        assert sorted(scores.tolist(), reverse=True) == sorted(sums.tolist(), reverse=True)[:k] and (sums[places] == scores).all()


def test_ties_at_the_last_slice():
    """More equal numbers than places: the first ones are taken."""
    numbers = np.array([3, 5, 3, 3, 0, 9] * 20 + [0] * 8)
    sliced = np.packbits(((numbers[None, :] >> np.arange(5)[:, None]) & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    places, scores = x.top(sliced, 45)
    want = sorted(range(len(numbers)), key=lambda i: (-numbers[i], i))[:45]
    assert sorted(places.tolist()) == sorted(want) and sorted(scores.tolist()) == sorted(numbers[want].tolist())
    assert len(x.top(sliced, 500)[0]) == 100  # none of the zeros


def test_query_over_its_tables(spark):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{D}/{name}.parquet").select(key, "text").collect()]
    assert got(x.op13_lexical_search(spark, D)) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))
