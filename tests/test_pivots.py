"""Nearest of many centroids, by groups in a shared table."""

import numpy as np
from pyspark.sql import functions as F

from readlake.operators import refine


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tables(spark, reads, cents):
    e = spark.createDataFrame([(i, x) for i, x in enumerate(reads.tolist())], "read_id long, embedding array<double>")
    return e.repartition(4), spark.createDataFrame([(i, x) for i, x in enumerate(cents.tolist())], "label int, centroid array<double>").repartition(4)


def test_many_centroids_equal_brute_force(spark):
    """25,000 centroids, more than are broadcast; reads are not shuffled."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 8))
    cents = unit(base[rng.integers(0, 200, 25_000)] + 0.05 * rng.normal(size=(25_000, 8)))
    cents[17] = cents[24_000]  # a tie
    reads = unit(np.concatenate([base[rng.integers(0, 200, 300)] + 0.05 * rng.normal(size=(300, 8)), rng.normal(size=(60, 8)), cents[[17, 24_000]]]))
    found = refine.nearest(*tables(spark, reads, cents))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the test's own repartition of the reads
    got = {r["read_id"]: (r["nearest"], r["distance"]) for r in found.collect()}
    cos = reads @ cents.T
    for i, row in enumerate(cos):
        assert cos[i, got[i][0]] >= row.max() - 1e-12 and abs(got[i][1] - np.sqrt(max(0, 2 - 2 * row.max()))) < 1e-6
    assert got[360][0] == got[361][0] == 17


def test_groups_are_left_out(spark, tmp_path):
    """Of well parted groups a read needs few; none that may hold its nearest centroid is passed over."""
    rng = np.random.default_rng(2)
    pivots = unit(rng.normal(size=(32, 16)))
    cents = unit(pivots[np.arange(640) % 32] + 0.02 * rng.normal(size=(640, 16)))
    away = refine._distances(cents, pivots)
    rows = [(int(g), int(i), c.tolist()) for i, (g, c) in enumerate(zip(away.argmin(1), cents))]
    spark.createDataFrame(rows, "grp int, label int, centroid array<double>").write.partitionBy("grp").parquet(str(tmp_path / "g"))
    own = away.argmin(1)
    ranges = {int(g): (away[own == g, g].min(), away[own == g, g].max()) for g in set(own.tolist())}
    groups = refine.Groups(str(tmp_path / "g"))
    reads = unit(pivots[:3] + 0.02 * rng.normal(size=(3, 16)))
    labels, _ = refine.by_pivots(reads, pivots, ranges, groups, 64)
    assert labels.tolist() == (reads @ cents.T).argmax(1).tolist() and groups.loaded < 8


def test_few_and_no_centroids(spark):
    reads, cents = unit(np.random.default_rng(3).normal(size=(20, 4))), unit(np.random.default_rng(4).normal(size=(3, 4)))
    r, c = tables(spark, reads, cents)
    want = (reads @ cents.T).argmax(1).tolist()
    for rows in (1, 100):
        assert [x["nearest"] for x in refine.nearest(r, c, broadcast_rows=rows).orderBy("read_id").collect()] == want
    assert refine.nearest(r, c.where(F.lit(False))).count() == 0
