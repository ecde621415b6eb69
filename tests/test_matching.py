"""Best matches found by blocks and growing radii, against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from readlake.operators import match


def some(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def edited(rng, seq, n):
    for _ in range(n):
        if not seq:
            break
        k, kind = rng.randrange(len(seq)), rng.randrange(3)
        seq = seq[:k] + (rng.choice("ACGT") + seq[k + 1 :] if kind == 0 else seq[k + 1 :] if kind == 1 else rng.choice("ACGT") + seq[k:])
    return seq


def levenshtein(a, b):
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ident(a, b):
    return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b)) if a and b else 0.0


@pytest.fixture(scope="module")
def rows():
    """Truths with matches of none to many errors, none at all, shared ends, short and empty ones, and ties."""
    rng = random.Random(4)
    primer = some(rng, 24)
    truth = [primer + some(rng, rng.choice([20, 60, 96])) for _ in range(24)] + [some(rng, 10), "", some(rng, 40)]
    pred = [edited(rng, t, n) for t in truth[:22] for n in (0, 1, 2, 4, 6, 11)[: rng.randint(1, 6)] if t] + [some(rng, 100) for _ in range(10)] + [truth[24], "AC", ""]
    swapped = [t[:30] + ("A" if t[30] != "A" else "C") + t[31:] for t in truth[:6]]
    rng.shuffle(pred)
    return [*enumerate(dict.fromkeys(pred + swapped))], [(100 + i, t) for i, t in enumerate(truth)]


def tables(spark, rows):
    return spark.createDataFrame(rows[0], "pred_id long, pred_seq string"), spark.createDataFrame(rows[1], "gt_id long, gt_seq string")


def best(a, b, score, most):
    out = {}
    for i, x in a:
        found = [(-round(score(x, y), 9), j) for j, y in b if abs(len(x) - len(y)) <= most]
        if found:
            out[i] = (min(found)[1], round(-min(found)[0], 6))
    return out


def test_best_by_edit(spark, rows):
    got = {r["gt_id"]: (r["pred_id"], round(r["score"], 6)) for r in match.best_by_edit(*tables(spark, rows)).collect()}
    score = lambda x, y: (1 - levenshtein(x, y) / max(len(x), len(y))) * 100 if x or y else 0.0
    want = best(rows[1], rows[0], score, 20)
    empty = next(i for i, t in rows[1] if not t)
    assert {k: v for k, v in got.items() if k != empty} == {k: v for k, v in want.items() if k != empty}


def test_best_by_identity(spark, rows):
    got = {r["pred_id"]: (r["gt_id"], round(r["score"], 6)) for r in match.best_by_identity(*tables(spark, rows)).collect()}
    want = best(rows[0], rows[1], ident, 10)
    empty = next(i for i, t in rows[0] if not t)
    assert {k: v for k, v in got.items() if k != empty} == {k: v for k, v in want.items() if k != empty}


@pytest.mark.parametrize("perfect", [0.999, 0.97, 0.5])
def test_recovered(spark, rows, perfect):
    got = {r["gt_id"] for r in match.recovered(*tables(spark, rows), perfect=perfect).collect()}
    assert got == {i for i, t in rows[1] if any(abs(len(t) - len(p)) <= 5 and ident(t, p) > perfect for _, p in rows[0])}


def test_candidates_are_few_in_spite_of_shared_ends(spark):
    """All sequences share 24 bases at their start; candidates are near the number of true pairs all the same."""
    rng = random.Random(5)
    primer = some(rng, 24)
    truth = [(i, primer + some(rng, 96)) for i in range(300)]
    pred = spark.createDataFrame([(1000 + i, edited(rng, t, 2)) for i, t in truth], "id long, seq string")
    index = match._index(pred, match.BLOCK_BASES, True)
    often = index.groupBy("key").agg(F.count("*").alias("n"))
    met = match.near_candidates(spark.createDataFrame(truth, "id long, seq string"), index, often, 2, match.BLOCK_BASES, True).collect()
    assert {(i, 1000 + i) for i in range(300)} <= {(r["id"], r["other_id"]) for r in met} and len(met) < 330


def test_known_rows_are_not_compared_with_all(spark, monkeypatch):
    """Where every reference has a near match, nothing is left for the comparison by length."""
    rng = random.Random(6)
    truth = [(i, some(rng, 120)) for i in range(40)]
    pred = [(100 + i, edited(rng, t, 2)) for i, t in truth]
    left = []
    plain = match.near_lengths
    monkeypatch.setattr(match, "near_lengths", lambda p, t, most: left.append(t.count()) or plain(p, t, most))
    got = match.best_by_edit(spark.createDataFrame(pred, "pred_id long, pred_seq string"), spark.createDataFrame(truth, "gt_id long, gt_seq string")).collect()
    assert left == [0] and {(r["gt_id"], r["pred_id"]) for r in got} == {(i, 100 + i) for i in range(40)}
