"""The quality classifier's fit over inputs whose classes part (nearly) without error, odd label tables, and held-out figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake.llm import common, quality_classifier
from readlake.llm.compression import filled, spread
from test_operators import labelled

D = "/root/testdata/sf0.1"


def chance(x, w):
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def test_the_fit_settles_on_classes_that_part_with_a_few_outliers():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        n = 400
        means, spreads = rng.uniform(0.3, 4, 2) * (1, -1), rng.uniform(0.1, 2, 2)
        one = np.concatenate([rng.normal(means[k], spreads[k], n) for k in (0, 1)])
        y = np.repeat([1.0, 0.0], n)
        for k in (0, 1):
            some = rng.integers(k * n, k * n + n, rng.integers(0, 4))
            one[some] = rng.normal(means[1 - k], spreads[1 - k], len(some))
        two = np.where((y == 0) & (rng.random(2 * n) < rng.uniform(0, 0.4)), -rng.uniform(0.01, 3, 2 * n), 0)
        x = np.column_stack([one, two, np.ones(2 * n)])
        w = quality_classifier.logistic(x, y, np.where(y == 1, 0.857, 0.143) * 2)
        p = chance(x, w)
        loss = np.average(-np.log(np.where(y == 1, p, 1 - p).clip(1e-12)), weights=np.where(y == 1, 0.857, 0.143))
        assert (w[:2] >= 0).all() and loss < -(0.857 * np.log(0.857) + 0.143 * np.log(0.143)) and (p[y == 1] >= 0.3).mean() > 0.9


def test_the_fit_of_useless_or_constant_features():
    y = np.repeat([1.0, 0.0], 50)
    x = np.column_stack([np.zeros(100), -y, np.ones(100)])
    w = quality_classifier.logistic(x, y, np.where(y == 1, 0.8, 0.2) * 2)
    assert w[:2].tolist() == [0, 0] and abs(chance(x, w) - 0.8).max() < 1e-6


def test_pieces_come_from_the_whole_text(spark):
    text = "".join(f"{i:04d}" for i in range(5000))
    rows = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, "é" * 700)], "doc_id long, text string").select("doc_id", spread(F.col("text"), 4096).alias("p"))
    got = {r["doc_id"]: r["p"] for r in rows.collect()}
    assert len(got[1]) == 8 and got[1][0] == text[:512] and got[1][-1] == text[-512:] and all(p in text for p in got[1])
    assert got[2] == ["short"] and got[3] == [""] and [len(p) for p in got[4]] == [512, 512]
    assert filled(["ab" * 400, "cd" * 400], 300) != b"" and len(filled(["ab" * 4000], 100)) == 100 and filled([], 9) == b""


def test_odd_labels_and_repeated_rows(spark):
    docs, labels, truth = labelled(spark)
    more = spark.createDataFrame([(None, 1, 0), (3, None, None), (5, 7, 7), (6, 1, 0), (6, 0, 1)], labels.schema)
    twice = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    model = quality_classifier.learn(twice, labels.unionByName(more))
    rows = quality_classifier.score(twice, model).collect()
    assert len(rows) == 403 + 41 and all(0 <= r["quality_score"] <= 1 for r in rows)
    right = [(r["quality_score"] >= 0.3) == (truth[r["doc_id"]][1] == 1) for r in rows if r["doc_id"] is not None and r["doc_id"] < 400]
    assert np.mean(right) > 0.97
    assert quality_classifier.learn(twice, labels.where("quality = 0")).weights == ()


@pytest.mark.parametrize("share", [1.0, 0.5])
def test_held_out_figures(spark, share):
    docs = common.table(spark, D, "documents").select("doc_id", "text")
    labels = common.table(spark, D, "labels")
    some = labels.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(100)) < 100 * share)
    rows = docs.join(labels.where(common.in_fold("doc_id")), "doc_id").select("doc_id", "text", "quality")
    got = quality_classifier.score(rows, quality_classifier.learn(docs, some)).select("quality", "quality_score").collect()
    good, bad = ([r["quality_score"] for r in got if r["quality"] == k] for k in (1, 0))
    assert np.mean(np.array(good) >= 0.3) >= 0.98 and np.mean(np.array(bad) < 0.3) >= 0.8
