"""The iterative driver: score, cut into zones, take centroids, refine, and stop when few labels change. Each round is a set of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.operators import decode, metrics, refine
from readlake.operators.scorer import Scorer, default_scorer
from readlake.plans.stages import Store, Table
from readlake.session import keep
from readlake.sources.sinks import write_log, write_round


def one_round(reads: DataFrame, labels: DataFrame, number: int, scorer: Scorer = default_scorer) -> dict[str, DataFrame]:
    """Tables labels, state, centroids, delta of a round. reads: read_id, seq; labels: read_id, label."""
    state = refine.zones(keep(scorer(reads.join(labels, "read_id"))))  # the cuts are one row
    cents = keep(refine.centroids(state))
    delta = keep(refine.radius(state, cents))
    done = keep(refine.refine(state, cents, delta, first_round=number == 1))
    confident = state.select("read_id", "seq", "strength", (F.col("zone") == 1).alias("high_conf")).join(done.select("read_id", F.col("new_label").alias("label")), "read_id")
    return {
        "summary": metrics.round_summary(state, done, decode.eligible(confident), delta, number),
        "labels": done.select("read_id", F.col("new_label").cast("int").alias("label"), "status"),
        "state": state.select("read_id", "label", "u_epi", "u_ale", "strength", "zone", "embedding"),
        "centroids": cents,
        "delta": delta,
    }


def iterate(reads: DataFrame, labels: DataFrame, root: str, rounds: int = 3, settled: float = 0.01, scorer: Scorer = default_scorer) -> DataFrame:
    """(read_id, label) after the rounds: noise goes to its nearest centroid at the end.

    A round is a stage of a store under root: one that is finished for these reads, these labels and this scorer is not run again. Its summary
    and the share of labels that changed go to the logs root/log and root/convergence, one row for each round.
    """
    spark: SparkSession = reads.sparkSession
    store, changes = Store(spark, root), []
    known, now = store.source(reads.select("read_id", "seq")), store.source(labels.select("read_id", "label"))
    for number in range(1, rounds + 1):
        run = lambda reads, labels, number=number: one_round(reads, labels, number, scorer)
        settings = {"number": number, "scorer": f"{scorer.__module__}.{scorer.__qualname__}"}
        done = store.stage(f"round={number}", run, {"reads": known, "labels": now}, settings, lambda tables, number=number: write_round(tables, root, number))
        after = Table(done["labels"].df.select("read_id", "label"), done["labels"].fingerprint)
        changed = metrics.change_rate(now.df, after.df).first()[0]
        now = after
        changes.append((number, changed))
        if changed is not None and changed < settled:
            break
    write_logs(spark, root, changes)
    return refine.assign_noise(now.df.join(done["state"].df.select("read_id", "embedding"), "read_id"), done["centroids"].df)


def write_logs(spark: SparkSession, root: str, changes: list[tuple[int, float | None]]) -> None:
    """The summaries of the rounds that were gone through, and (round, label_change_rate); a row for each round, so one file each."""
    summaries = reduce(DataFrame.unionByName, (spark.read.parquet(f"{root}/round={number}/summary") for number, _ in changes))
    write_log(summaries.orderBy("round"), f"{root}/log", "overwrite")
    write_log(spark.createDataFrame(changes, "round int, label_change_rate double").orderBy("round"), f"{root}/convergence", "overwrite")
