"""Scores of reads: equal to plain Python's in any number of pieces, alike for copies, and without a shuffle of places."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from readlake.operators import scorer


def digamma(x):
    low = 0.0
    while x < 20:
        low, x = low - 1 / x, x + 1
    return low + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def scores(rows):
    """strength, u_epi and u_ale of each (read_id, label, seq), place by place."""
    out = {}
    for i, label, seq in rows:
        each = []
        for at, base in enumerate((seq or "") if label is not None else ""):
            there = [s[at] for _, other, s in rows if other == label and s and len(s) > at]
            own = there.count(base) if base in "ACGT" else 0
            alpha = [own + 1, *[(len(there) - own) / 3 + 1] * 3]
            each.append(alpha)
        parts = []
        for alpha in each or [[1.0] * 4]:
            s = sum(alpha)
            ale = sum(a / s * (digamma(s + 1) - digamma(a + 1)) for a in alpha)
            epi = sum(a / s * (digamma(a + 1) - digamma(s + 1)) - a / s * math.log(a / s) for a in alpha)
            parts.append((s, max(epi, 0.0), min(max(ale, 0.0), 0.95)))
        out[i] = [sum(p[k] for p in parts) / len(parts) for k in range(3)]
    return out


@pytest.mark.parametrize(("piece", "few"), [(256, 1024), (16, 1024), (16, 0), (1, 3)])
def test_scores_in_pieces(spark, monkeypatch, piece, few):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("AACGTN") for _ in range(n))
    rows = [(i, rng.choice([-1, 1, 2, 3]), word(rng.choice([0, 1, 15, 16, 17, 32, rng.randrange(50)]))) for i in range(70)]
    rows += [(70, 1, None), (71, None, "ACGT"), (72, 9, "é\U0001d4d0A"), (73, 9, "")]
    monkeypatch.setattr(scorer, "PIECE", piece)
    monkeypatch.setattr(scorer, "BROADCAST_PIECES", few)
    got = scorer.default_scorer(spark.createDataFrame(rows, "read_id long, label int, seq string").repartition(5)).collect()
    want = scores(rows)
    assert len(got) == len(rows)
    for r in got:
        assert all(abs(a - b) < 1e-7 for a, b in zip((r["strength"], r["u_epi"], r["u_ale"]), want[r["read_id"]], strict=True)), r


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_copies_score_alike(spark, partitions):
    rng = random.Random(9)
    seqs = ["".join(rng.choice("ACGT") for _ in range(150)) for _ in range(6)]
    rows = spark.createDataFrame([(i, 1, seqs[i % 6]) for i in range(120)], "read_id long, label int, seq string").repartition(partitions)
    got = scorer.default_scorer(rows).select("seq", "strength", "u_epi", "u_ale").distinct().collect()
    assert len(got) == 6


@pytest.mark.parametrize("few", [1024, 0])
def test_places_of_reads_are_not_shuffled(spark, monkeypatch, few):
    monkeypatch.setattr(scorer, "BROADCAST_PIECES", few)
    reads = spark.range(50).select(F.col("id").alias("read_id"), (F.col("id") % 3).cast("int").alias("label"), F.lit("ACGT").alias("seq")).repartition(3)
    plan = scorer.default_scorer(reads)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not any("pos#" in d or "known#" in d for d in dealt)
