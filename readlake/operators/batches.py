"""Batches of clusters, word tables, and difference texts."""

from __future__ import annotations

import difflib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def pack(clusters: DataFrame, size: int, cluster: str = "cid", n: str = "n", most_clusters: int = 64, lanes: int = 1) -> DataFrame:
    """(cluster, n, lane, batch_id, begin, taken): which reads of a cluster, from `begin` on, go to which batch of its lane.

    Clusters of two reads or more come in order. One that no longer fits, or comes after most_clusters others, begins the next batch; one
    larger than a batch is cut into batches of its own. Singletons fill batches of their own after all others. Lanes by hash of the cluster
    are packed apart, each by one task that holds a number and a key for each of its clusters.
    """
    kind = clusters.schema[cluster].dataType

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(cluster)
        lane, batch, room, held, out, alone = rows.column("lane")[0].as_py(), -1, 0, 0, [], []
        for key, k in zip(rows.column(cluster).to_pylist(), rows.column(n).to_pylist(), strict=True):
            if k < 2:
                alone.append((key, k))
            elif k > size:
                for begin in range(0, k, size):
                    batch += 1
                    out.append((key, k, batch, begin, min(size, k - begin)))
                room = 0
            else:
                if k > room or held >= most_clusters:
                    batch, room, held = batch + 1, size, 0
                room, held = room - k, held + 1
                out.append((key, k, batch, 0, k))
        out += [(key, k, batch + 1 + i // size, 0, k) for i, (key, k) in enumerate(alone)]
        columns = [*zip(*out, strict=True)]
        return pa.table({cluster: pa.array(columns[0], rows.schema.field(cluster).type), n: pa.array(columns[1], pa.int64()), "lane": pa.array([lane] * len(out), pa.int32()), "batch_id": pa.array(columns[2], pa.int64()), "begin": pa.array(columns[3], pa.int64()), "taken": pa.array(columns[4], pa.int64())})

    rows = clusters.select(cluster, F.col(n).cast("long").alias(n), F.pmod(F.xxhash64(cluster), F.lit(lanes)).cast("int").alias("lane"))
    return rows.groupBy("lane").applyInArrow(run, f"`{cluster}` {kind.simpleString()}, `{n}` long, lane int, batch_id long, begin long, taken long")


def batch_statistics(packed: DataFrame, n: str = "n", cluster: str = "cid") -> DataFrame:
    """n_batches, mean_size, n_clusters (of two reads or more), n_singletons."""
    sizes = packed.groupBy("lane", "batch_id").agg(F.sum("taken").alias("s")).agg(F.count("*").alias("n_batches"), F.avg("s").alias("mean_size"))
    first = packed.where("begin = 0").agg(F.count_if(F.col(n) >= 2).alias("n_clusters"), F.count_if(F.col(n) < 2).alias("n_singletons"))
    return sizes.crossJoin(first)  # one row each


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """rows with `place`, a sort key that shuffles them alike in every run."""
    return rows.withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))


def equal_runs(rows: DataFrame, key: str, size: str, batch: int, seed: int = 0) -> DataFrame:
    """rows with run_batch: rows of one size are shuffled among themselves and cut into batches, which never cross to another size.

    Places are dealt to ranges of the shuffle key first, so that a size that most rows have is not the work of one task.
    """
    dealt = shuffled(rows, key, seed).withColumn("_range", F.substring("place", 1, 2))
    before = dealt.groupBy(size, "_range").agg(F.count("*").alias("k"))  # 256 rows at most for each size
    before = before.withColumn("_before", F.coalesce(F.sum("k").over(Window.partitionBy(size).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    at = F.row_number().over(Window.partitionBy(size, "_range").orderBy("place", key)) - 1
    return dealt.withColumn("_at", at).join(before, [size, "_range"]).withColumn("run_batch", F.expr(f"(_before + _at) div {batch}")).drop("_range", "_at", "_before", "place")


def permutations(spark: SparkSession, k: int, alphabet: str = "ATGC") -> DataFrame:
    """All words of k letters (word): the prefixes that partitions are named by."""
    out = spark.range(1).select(F.lit("").alias("word"))
    for _ in range(k):
        out = out.select("word", F.explode(F.array(*map(F.lit, alphabet))).alias("c")).select(F.concat("word", "c").alias("word"))
    return out


@F.pandas_udf(StringType())
def difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """(x->y) for replaced, [y] for inserted, (-x) for deleted runs; equal runs stay."""

    def shown(x: str, y: str) -> str:
        parts = []
        for op, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            parts.append({"equal": x[i:j], "replace": f"({x[i:j]}->{y[k:m]})", "insert": f"[{y[k:m]}]", "delete": f"(-{x[i:j]})"}[op])
        return "".join(parts)

    return pd.Series([None if x is None or y is None else shown(x, y) for x, y in zip(a, b, strict=True)])
