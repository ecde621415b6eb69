"""Rounds of federated averaging against plain numbers."""

from pyspark.sql import functions as F

from readlake.operators import federated


def tables(spark):
    own = spark.createDataFrame([(c, "w", i, v) for c, vs in ((0, [1.0, 5.0]), (1, [3.0, 1.0]), (2, [9.0, 0.0])) for i, v in enumerate(vs)], "client int, param string, idx int, value double")
    return own.where("client = 0").select("param", "idx", F.lit(0.0).alias("value")), own, spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 1.0)], "client int, weight double")


def test_rounds_go_to_the_weighted_mean(spark):
    start, own, weights = tables(spark)
    found, _, n = federated.loop(start, weights, federated.pulled(own, 0.5), 30, settled=1e-6)
    assert 10 < n < 30 and all(abs(r["value"] - {0: 3.5, 1: 2.75}[r["idx"]]) < 1e-5 for r in found.collect())
    once, _, n = federated.loop(start, weights, federated.pulled(own, 0.5), 1)
    assert n == 1 and {r["idx"]: round(r["value"], 9) for r in once.collect()} == {0: 1.75, 1: 1.375}


def test_scores_change_the_weights(spark):
    """A client of much global evidence and little local doubt counts more and more."""
    start, own, weights = tables(spark)
    scores = lambda made: made.select("client").distinct().select("client", *(F.when(F.col("client") == 2, a).otherwise(b).alias(n) for n, a, b in (("g_epi", 9.0, 0.0), ("g_ale", 0.1, 0.1), ("l_epi", 0.1, 1.0), ("l_ale", 0.1, 1.0))))
    found, after, _ = federated.loop(start, weights, federated.pulled(own, 1.0), 3, scores)
    w = {r["client"]: r["weight"] for r in after.collect()}
    assert w[2] > 0.99 and abs({r["idx"]: r["value"] for r in found.collect()}[0] - 9.0) < 0.1
