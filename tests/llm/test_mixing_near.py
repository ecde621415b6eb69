"""Small sources come as near to their targets as whole documents allow, or within half a percent."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from readlake.llm import mixing

D = "/root/testdata/sf0.001"


def off(spark, docs):
    """By source: how far what is taken lies from the target, and how far the best subset of one more take of each would be (None: too many documents)."""
    rows = mixing.mix(docs).collect()
    out = {}
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        total, target = own[0]["source_size"], own[0]["target"]
        if not total:
            continue
        taken = sum(r["taken"] for r in own)
        assert all(r["taken"] <= 3 * r["size"] for r in own)
        sizes, rest = [r["size"] for r in own if r["size"]], target - target // total * total
        best = min(abs(sum(x) - rest) for n in range(len(sizes) + 1) for x in itertools.combinations(sizes, n)) if len(sizes) <= 12 else None
        out[source] = (abs(taken - target), best, target)
    return out


def test_driver_tables(spark):
    for source, (away, best, target) in off(spark, spark.read.parquet(f"{D}/documents.parquet")).items():
        assert away <= max(0.005 * target, best or 0, 1), (source, away, best, target)


@pytest.mark.parametrize("seed", [1, 2])
def test_sources_of_few_documents(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * int(rng.lognormvariate(4, 1)), f"src{i % 9}") for i in range(70)] + [(3, "w " * 50, "src3"), (None, "w " * 9, None)]
    for source, (away, best, target) in off(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).items():
        assert best is None or away <= max(best, 1, 0.005 * target), (source, away, best, target)


def test_many_sources(spark):
    """A thousand sources of three documents; each is as near as its documents allow."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (1 + F.col("id") * 7919 % 40).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 1000).cast("string")).alias("source"))
    assert all(away <= best + 1 for away, best, _ in off(spark, docs).values())
