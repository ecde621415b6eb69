"""Clustering that goes on from chunk to chunk: founders are state, kept by prefix, and each epoch's assignments are a table of their own.

A micro-batch is placed in order of read_id, after all that came before it. Of a founder its read is kept; the indexes over the anchors
are made again from these where a prefix has new reads. Prefixes never meet, so `prefix` of the configuration sets both how far
the work spreads and how many founders one state holds. A restarted query takes state and progress from its checkpoint; the epoch
that was cut short is run again and its table written over, so no read is assigned twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from readlake.operators.cluster import ClusterConfig, OnlineClusters, prefixed
from readlake.session import importable

ASSIGNED = "read_id long, cluster_id long, status string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FounderState(StatefulProcessor):
    """Places the reads of one prefix; its founders are a list in order of arrival."""

    def __init__(self, cfg: ClusterConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.founders = handle.getListState("founders", "read_id long, seq string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = OnlineClusters(self.cfg)
        if self.founders.exists():
            state.restore(self.founders.get())
        reads = pd.concat([*rows]).sort_values("read_id", kind="stable")
        for a in range(0, len(reads), state.CODED):
            part = reads.iloc[a : a + state.CODED]
            ids, seqs = part["read_id"].tolist(), part["seq"].tolist()
            placed = state.place_all(ids, seqs)
            if new := [(i, seq) for i, seq, (_, status) in zip(ids, seqs, placed, strict=True) if status == "founder"]:
                self.founders.appendList(new)
            yield pd.DataFrame({"read_id": ids, "cluster_id": pd.array([c for c, _ in placed], dtype="Int64"), "status": [s for _, s in placed]})

    def close(self) -> None:
        pass


def clustered(stream: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """(read_id, cluster_id, status) of a stream of reads (read_id, seq)."""
    rows = prefixed(stream, cfg).groupBy("prefix")
    return rows.transformWithStateInPandas(FounderState(cfg), outputStructType=ASSIGNED, outputMode="Append", timeMode="None")


def start(stream: DataFrame, root: str, cfg: ClusterConfig = ClusterConfig()) -> StreamingQuery:
    """Places what is there, as far as it has not been placed: assignments under root, a folder for each epoch; state and progress beside them."""
    spark = stream.sparkSession
    importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/assigned/epoch={epoch}")

    return clustered(stream, cfg).writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()


def assigned(spark: SparkSession, root: str) -> DataFrame:
    """All assignments so far: read_id, cluster_id, status, epoch."""
    return spark.read.schema(f"{ASSIGNED}, epoch long").parquet(f"{root}/assigned")


def in_chunks(reads: DataFrame, root: str, cfg: ClusterConfig = ClusterConfig(), chunks: int = 3) -> DataFrame:
    """Reads arrive in chunks of ascending read_id, each in a run of its own that goes on from the checkpoint of the one before."""
    spark = reads.sparkSession
    bounds = [b for b in reads.agg(F.percentile_approx("read_id", [(k + 1) / chunks for k in range(chunks - 1)])).first()[0] or []] if chunks > 1 else []
    stream = spark.readStream.schema(reads.select("read_id", "seq").schema).parquet(f"{root}/in/*")
    for k in range(len(bounds) + 1):
        part = reads.select("read_id", "seq")
        part = part.where(F.col("read_id") > bounds[k - 1]) if k else part
        part = part.where(F.col("read_id") <= bounds[k]) if k < len(bounds) else part
        part.write.mode("overwrite").parquet(f"{root}/in/chunk={k}")
        start(stream, root, cfg).awaitTermination()
    return assigned(spark, root)
