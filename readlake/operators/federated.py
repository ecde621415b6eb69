"""Federated averaging: parameters as rows (client, param, idx, value), client weights as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readlake.session import keep


def average(parameters: DataFrame, weights: DataFrame) -> DataFrame:
    """(param, idx, value): the weighted sum over clients (client, weight)."""
    return parameters.join(weights, "client").groupBy("param", "idx").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def reweigh(clients: DataFrame, least: float = 1e-3, eps: float = 1e-8) -> DataFrame:
    """(client, weight) from weight, g_epi, g_ale, l_epi, l_ale: add g_epi / ((l_epi + eps)(l_ale + g_ale + eps)), normalise, clip from below."""
    raw = F.col("weight") + F.col("g_epi") / ((F.col("l_epi") + eps) * (F.col("l_ale") + F.col("g_ale") + eps))
    grown = clients.select("client", raw.alias("w"))
    total = grown.agg(F.sum("w").alias("total"))
    return grown.crossJoin(F.broadcast(total)).select("client", F.greatest(F.col("w") / F.col("total"), F.lit(least)).alias("weight"))  # total is one row


Local = Callable[[DataFrame, int], DataFrame]


def loop(start: DataFrame, weights: DataFrame, local: Local, rounds: int, scores: Callable[[DataFrame], DataFrame] | None = None, settled: float = 0.0) -> tuple[DataFrame, DataFrame, int]:
    """Parameters (param, idx, value), weights (client, weight) and the number of rounds that were run.

    In a round every client goes on from the same parameters: local(parameters, number) gives (client, param, idx, value). `scores` of these (client, g_epi,
    g_ale, l_epi, l_ale) change the weights, if given, which are used as shares of their sum. It ends after `rounds`, or when no parameter moves by more
    than `settled`. Parameters and weights of a round are kept, so that a round's plan begins at the one before.
    """
    number = 0
    for number in range(1, rounds + 1):
        made = keep(local(start, number))
        if scores is not None:
            weights = keep(reweigh(weights.join(scores(made), "client")))
        total = weights.agg(F.sum("weight").alias("total"))
        shares = weights.crossJoin(F.broadcast(total)).select("client", (F.col("weight") / F.col("total")).alias("weight"))  # total is one row
        new = keep(average(made, shares))
        moved = new.join(start.select("param", "idx", F.col("value").alias("old")), ["param", "idx"]).agg(F.max(F.abs(F.col("value") - F.col("old")))).first()[0]
        start = new
        if moved is None or moved <= settled:
            break
    return start, weights, number


def pulled(towards: DataFrame, rate: float) -> Local:
    """Local steps of clients whose loss is half the squared distance to parameters of their own (client, param, idx, value)."""
    own = towards.select("client", "param", "idx", F.col("value").alias("own"))
    return lambda now, number: own.join(now, ["param", "idx"]).select("client", "param", "idx", (F.col("value") - rate * (F.col("value") - F.col("own"))).alias("value"))


def moving_average(old: DataFrame, new: DataFrame, alpha: float = 0.2) -> DataFrame:
    """(param, idx, value): alpha * new + (1 - alpha) * old"""
    joined = old.select("param", "idx", F.col("value").alias("o")).join(new.select("param", "idx", F.col("value").alias("n")), ["param", "idx"])
    return joined.select("param", "idx", (alpha * F.col("n") + (1 - alpha) * F.col("o")).alias("value"))


def exact_accuracy(rows: DataFrame, pred: str, truth: str) -> DataFrame:
    return rows.agg((100 * F.avg((F.col(pred) == F.col(truth)).cast("double"))).alias("accuracy"))


def running_mean(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Means over batches so far."""
    over = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mean", F.avg(value).over(over))


def fused(rows: DataFrame, by: str, strength: str, evidence: str) -> DataFrame:
    """(by, idx, plain, weighted): mean of the reads' evidence at each place, plain and under softmax weights of their strengths.

    A softmax is a ratio of two sums, so that each group is combined before it is shuffled. Strengths are at most 1."""
    spots = rows.select(by, F.exp(strength).alias("weight"), F.posexplode(evidence).alias("idx", "value"))
    weighted = F.sum(F.col("weight") * F.col("value")) / F.sum("weight")
    return spots.groupBy(by, "idx").agg(F.avg("value").alias("plain"), weighted.alias("weighted"))
