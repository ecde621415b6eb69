"""k-mers counted by built-in functions over whole sequences."""

import math
import random

from pyspark.sql import functions as F

from readlake.operators import scorer


def test_embedding_counts_overlaps(spark):
    rng = random.Random(3)
    seqs = ["", "A", "AA", "AAAAA", "ACACACA", "NNAANAA", None, *("".join(rng.choice("AACGTN") for _ in range(rng.randrange(60))) for _ in range(40))]
    for k in (1, 2, 3):
        rows = spark.createDataFrame([*enumerate(seqs)], "i int, seq string")
        got = {r["i"]: r["e"] for r in rows.select("i", scorer.kmer_embedding(F.col("seq"), k).alias("e")).collect()}
        for i, x in enumerate(seqs):
            n = [sum((x or "")[j : j + k] == w for j in range(len(x or ""))) for w in scorer.kmers(k)]
            size = math.sqrt(sum(c * c for c in n))
            assert all(abs(a - (c / size if size else 0.0)) < 1e-12 for a, c in zip(got[i], n, strict=True)), (k, x)


def test_no_function_for_each_word_of_each_read(spark):
    plan = spark.createDataFrame([("ACGT",)], "seq string").select(scorer.kmer_embedding(F.col("seq")))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan
