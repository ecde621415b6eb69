"""Zones, weighted centroids, the global radius, reassignment and assignment of noise.

Reads carry read_id, label (-1: noise), embedding (unit vector), u_epi, u_ale and strength.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions import vector as v
from readlake.session import shared_root

DIRTY, SAFE = 0.90, 0.70
BROADCAST_ROWS = 20_000


def exact_percentile(rows: DataFrame, column: str, share: float, most: int = 1_000_000) -> float | None:
    """The interpolated percentile, as Spark's own gives it, which holds every distinct value in one task: here approximate percentiles narrow
    the values down first, until `most` rows or one value are left between the bounds. A few numbers go to the driver each time."""
    x = F.col(column)
    rows = rows.where(x.isNotNull()).select(x)
    n = rows.count()
    if not n:
        return None
    rank, below, left = share * (n - 1), 0, n
    while left > most:
        f, edge = (rank - below) / max(1, left - 1), 4 / most**0.5
        low, high = rows.agg(F.percentile_approx(column, [max(0.0, f - edge), min(1.0, f + edge)], int(4 / edge) + 1000)).first()[0]
        # the values at both whole ranks beside the wanted one must stay inside
        under, upto = rows.agg(F.count_if(x < low), F.count_if(x <= high)).first()
        keep_low, keep_high = below + under <= int(rank), int(rank) + 1 < below + upto
        inside = rows.where((x >= low if keep_low else F.lit(True)) & (x <= high if keep_high else F.lit(True)))
        now = (upto if keep_high else left) - (under if keep_low else 0)
        if low == high and keep_low and keep_high:
            return float(low)
        if now >= left:
            break
        rows, below, left = inside, below + (under if keep_low else 0), now
    return rows.agg(F.percentile(column, F.lit((rank - below) / (left - 1) if left > 1 else 0.0))).first()[0]


def zone_cuts(reads: DataFrame, dirty: float = DIRTY, safe: float = SAFE) -> DataFrame:
    """One row (cut_ale, cut_epi): the aleatoric quantile over labelled reads, then the epistemic one over those below it."""
    labelled = reads.where("label >= 0")
    ale = exact_percentile(labelled, "u_ale", dirty)
    epi = None if ale is None else exact_percentile(labelled.where(F.col("u_ale") < ale), "u_epi", safe)
    return reads.sparkSession.createDataFrame([(ale, epi)], "cut_ale double, cut_epi double")


def zones(reads: DataFrame, dirty: float = DIRTY, safe: float = SAFE) -> DataFrame:
    """zone: 0 noise, 3 dirty (u_ale at the cut or above), 1 safe (u_epi at the cut or below), else 2."""
    cut = reads.crossJoin(F.broadcast(zone_cuts(reads, dirty, safe)))  # one row
    zone = F.when(F.col("label") < 0, 0).when(F.col("u_ale") >= F.col("cut_ale"), 3).when(F.col("u_epi") <= F.col("cut_epi"), 1).otherwise(2)
    return cut.withColumn("zone", zone).drop("cut_ale", "cut_epi")


def centroids(reads: DataFrame, least_safe: int = 3, clamp: float = 0.30) -> DataFrame:
    """(label, centroid, n): unit vector of the strength-weighted mean over zones 1 and 2.

    In a cluster with fewer than `least_safe` safe reads, weights of zone 2 are at most `clamp`. Clusters without weight go.
    """
    used = reads.where("label >= 0 AND zone IN (1, 2)")
    safe = used.groupBy("label").agg(F.count_if(F.col("zone") == 1).alias("n_safe"), F.count("*").alias("n"))
    weight = F.when((F.col("n_safe") < least_safe) & (F.col("zone") == 2), F.least("strength", F.lit(clamp))).otherwise(F.col("strength"))
    weighted = used.join(safe, "label").select("label", "n", weight.alias("w"), F.posexplode("embedding").alias("dim", "x"))
    sums = weighted.groupBy("label", "n", "dim").agg(F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum("w").alias("w")).where("w > 1e-6")
    mean = sums.groupBy("label", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", (F.col("wx") / F.col("w")).alias("x")))), lambda s: s["x"]).alias("c"))
    return mean.select("label", v.unit(F.col("c")).alias("centroid"), "n")


def own_distances(reads: DataFrame, cents: DataFrame) -> DataFrame:
    """Reads with the distance to their own cluster's centroid; reads of other clusters go."""
    return reads.join(cents.select("label", "centroid"), "label").withColumn("own_distance", v.unit_distance(F.col("embedding"), F.col("centroid"))).drop("centroid")


def radius(reads: DataFrame, cents: DataFrame, quantile: float = 0.95, fallback: float = 0.5) -> DataFrame:
    """One row (delta): the quantile of safe reads' distances to their centroids, over all of them."""
    d = own_distances(reads.where("zone = 1"), cents)
    found = exact_percentile(d, "own_distance", quantile)
    return reads.sparkSession.createDataFrame([(fallback if found is None else found,)], "delta double")


def nearest_sql(reads: DataFrame, cents: DataFrame) -> DataFrame:
    """(read_id, nearest, distance) by built-in expressions: each read meets each of a few centroids, which are counted first; many go to nearest(). Ties: least label."""
    if cents.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return nearest(reads, cents)
    c = cents.select(F.col("label").alias("c_label"), "centroid")
    met = reads.select("read_id", "embedding").crossJoin(F.broadcast(c)).select("read_id", "c_label", v.unit_distance(F.col("embedding"), F.col("centroid")).alias("d"))
    return met.groupBy("read_id").agg(F.min(F.struct("d", "c_label")).alias("m")).select("read_id", F.col("m.c_label").alias("nearest"), F.col("m.d").alias("distance"))


def _dense(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_pylist(), np.float64)


def _distances(e: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (e @ vectors.T)))


def _closest(e: np.ndarray, vectors: np.ndarray, labels: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Label and distance of the nearest vector of each row; labels ascend, and ties go to the first."""
    at, cos = np.empty(len(e), np.int64), np.empty(len(e))
    for a in range(0, len(e), block):
        sims = e[a : a + block] @ vectors.T
        at[a : a + block] = sims.argmax(1)
        cos[a : a + block] = sims.max(1)
    return labels[at], np.sqrt(np.maximum(0, 2 - 2 * cos))


def nearest(reads: DataFrame, cents: DataFrame, broadcast_rows: int = BROADCAST_ROWS, block: int = 2048) -> DataFrame:
    """(read_id, nearest, distance) by blocked matrix products over Arrow batches. Ties: least label.

    Centroids are counted first: up to broadcast_rows they travel to the reads. Beyond it they are grouped around pivots in a shared
    table, from which tasks read the groups that they need; reads stay where they are.
    """
    spark, n = reads.sparkSession, cents.count()
    rows = reads.select("read_id", "embedding")
    if n > broadcast_rows:
        return _nearest_by_pivots(rows, cents, block)
    found = sorted(cents.select("label", "centroid").collect(), key=lambda r: r["label"])
    if not found:
        return rows.limit(0).select("read_id", F.lit(0).alias("nearest"), F.lit(0.0).alias("distance"))
    shared = spark.sparkContext.broadcast((np.array([r["centroid"] for r in found]), np.array([r["label"] for r in found])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _batch_of(b.column("read_id"), *_closest(_dense(b.column("embedding")), *shared.value, block))

    return rows.mapInArrow(run, NEAREST)


NEAREST = "read_id long, nearest int, distance double"
PIVOTS, SLACK, HELD_BYTES = 256, 1e-6, 256 << 20


def _batch_of(ids: pa.Array, labels: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([ids, pa.array(labels, pa.int32()), pa.array(distance)], ["read_id", "nearest", "distance"])


class Groups:
    """The groups of a shared table (grp, label, centroid), read as they are asked for; the last ones stay, up to HELD_BYTES."""

    def __init__(self, root: str):
        self.root, self.held, self.size, self.loaded = root, {}, 0, 0

    def get(self, grp: int) -> tuple[np.ndarray, np.ndarray]:
        if grp not in self.held:
            fs, path = pafs.FileSystem.from_uri(self.root)
            found = [f for f in fs.get_file_info(pafs.FileSelector(f"{path}/grp={grp}")) if f.base_name.endswith(".parquet")]
            tables = [pq.read_table(f.path, filesystem=fs, columns=["label", "centroid"], partitioning=None) for f in found]
            table = pa.concat_tables(tables).sort_by("label")
            vectors = np.asarray(table.column("centroid").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
            self.loaded += 1
            while self.held and self.size + vectors.nbytes > HELD_BYTES:
                self.size -= self.held.pop(next(iter(self.held)))[0].nbytes
            self.held[grp], self.size = (vectors, np.asarray(table.column("label"))), self.size + vectors.nbytes
        return self.held[grp]


def by_pivots(e: np.ndarray, pivots: np.ndarray, ranges: dict[int, tuple[float, float]], groups: Groups, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Label and distance of the nearest centroid of each row of e.

    By the triangle inequality a centroid at a distance r from its pivot is at least |d - r| from what is d from the pivot. Groups are
    visited by the least they may have, each for the rows only for which that is not beyond the best found so far.
    """
    d = _distances(e, pivots)
    grps = np.array(sorted(ranges))
    low, high = (np.array([ranges[g][k] for g in grps]) for k in (0, 1))
    bound = np.maximum(0, np.maximum(d[:, grps] - high, low - d[:, grps]))
    best, label = np.full(len(e), np.inf), np.full(len(e), np.iinfo(np.int64).max)
    # first each row's own group, that of its nearest pivot
    own = d[:, grps].argmin(1)
    order = [*dict.fromkeys(own.tolist()), *[g for g in np.argsort(bound.min(0), kind="stable").tolist() if g not in set(own.tolist())]]
    for first in (True, False):
        for g in order:
            rows = np.flatnonzero(own == g) if first else np.flatnonzero((own != g) & (bound[:, g] <= best + SLACK))
            if len(rows):
                labels, away = _closest(e[rows], *groups.get(int(grps[g])), block)
                nearer = (away < best[rows]) | ((away == best[rows]) & (labels < label[rows]))
                best[rows[nearer]], label[rows[nearer]] = away[nearer], labels[nearer]
    return label, best


def _nearest_by_pivots(rows: DataFrame, cents: DataFrame, block: int) -> DataFrame:
    spark = rows.sparkSession
    pivots = np.array([r["centroid"] for r in cents.select("centroid", "label").orderBy(F.xxhash64("label"), "label").limit(PIVOTS).collect()])
    shared = spark.sparkContext.broadcast(pivots)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_dense(b.column("centroid")), shared.value)
                yield pa.record_batch([pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1)), b.column("label").cast(pa.int32()), b.column("centroid")], ["grp", "away", "label", "centroid"])

    root = f"{shared_root(spark)}/centroids-{uuid.uuid4().hex}"
    cents.select("label", "centroid").mapInArrow(grouped, "grp int, away double, label int, centroid array<double>").repartition("grp").write.partitionBy("grp").parquet(root)
    ranges = {r["grp"]: (r["low"], r["high"]) for r in spark.read.parquet(root).groupBy("grp").agg(F.min("away").alias("low"), F.max("away").alias("high")).collect()}  # PIVOTS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups(root)
        for b in batches:
            if b.num_rows:
                yield _batch_of(b.column("read_id"), *by_pivots(_dense(b.column("embedding")), shared.value, ranges, groups, block))

    return rows.mapInArrow(run, NEAREST)


def refine(reads: DataFrame, cents: DataFrame, delta: DataFrame, first_round: bool = False, by_sql: bool = False) -> DataFrame:
    """(read_id, label, zone, new_label, status). Safe reads keep their label, dirty ones become noise; a read of zone 2 goes to the
    nearest centroid if that is nearer than delta (1.5 delta in the first round), else it becomes noise; noise stays noise."""
    near = (nearest_sql if by_sql else nearest)(reads.where("zone = 2"), cents)
    joined = reads.select("read_id", "label", "zone").join(near, "read_id", "left").crossJoin(F.broadcast(delta))  # delta is one row
    inside = F.coalesce(F.col("distance") < F.col("delta") * (1.5 if first_round else 1.0), F.lit(False))
    new = F.when(F.col("zone").isin(0, 1), F.col("label")).when((F.col("zone") == 2) & inside, F.col("nearest")).otherwise(-1)
    status = F.when(F.col("zone") == 0, "noise").when(F.col("zone") == 1, "safe").when(F.col("zone") == 3, "dirty").when(~inside, "rejected").when(F.col("nearest") == F.col("label"), "confirmed").otherwise("moved")
    return joined.select("read_id", "label", "zone", new.alias("new_label"), status.alias("status"))


def refine_counts(refined: DataFrame) -> DataFrame:
    return refined.agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("safe", "confirmed", "moved", "rejected", "dirty", "noise")))


def assign_noise(reads: DataFrame, cents: DataFrame, by_sql: bool = False) -> DataFrame:
    """(read_id, label): noise goes to its nearest centroid whatever the distance, other reads keep their label."""
    near = (nearest_sql if by_sql else nearest)(reads.where("label < 0"), cents)
    return reads.select("read_id", "label").join(near, "read_id", "left").select("read_id", F.coalesce("nearest", "label").alias("label"))
