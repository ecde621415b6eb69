"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is dealt by hash of doc_id into blocks of a few thousand documents. A target of r whole sources and a rest asks for
r draws of every block and one more of the first blocks of a permutation. The block that the rest ends in gives every document that
still fits in its turn, and so do the blocks after it in the permutation, until no document of the source fits: what is missing is
then less than any document not taken. The one document that comes closest to it is added, if that brings the source
nearer to its target. Where it ends nearer if the block gives only the documents before the first that does not fit, and the
closest one, that is done instead. At last, of SWAPPED documents that are taken once more and as many that are not, by hash, the set is
exchanged whose sizes bring the source nearest to its target, of all such sets. These documents go where the block goes that the rest ends in. A tree then splits the block draws of all sources among the output shards: at each node
the left half's share of each source is a draw from the multivariate hypergeometric distribution, so quotas are exact at every
level and no shard is favoured. A shard takes disjoint runs of each source's permuted draws and orders documents by a hash.

To the driver come one row for each source, never rows of documents or blocks; tables of sources are broadcast up to
BROADCAST_SOURCES rows, else shuffled. Every choice is a hash under `seed`, so that
reruns agree.

Defined results: a null text has size 0; sources of size 0 have target 0; a null source is a source of its own, last in
order. Rows that repeat a doc_id are taken alike; a null doc_id is dealt like any other value. An empty table gives an empty
result. Other columns are left alone.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readlake.llm import common as c

WEIGHTS, CAP, SHARDS, BLOCK_DOCS, SEED = (5, 2, 1), 3, 64, 2048, 17
SWAPPED = 10
BROADCAST_SOURCES = 20_000


def targets(sizes: list[int], weights: list[int], total: int, cap: int = CAP) -> list[Fraction]:
    """total shared by weight; no share over cap times its size, what is above is shared anew among the others."""
    out: list[Fraction | None] = [None] * len(sizes)
    left = Fraction(total)
    while open_ := [i for i, t in enumerate(out) if t is None]:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        for i in over or open_:
            out[i] = Fraction(cap * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(cap * sizes[i] for i in over)
    return out


def split_draws(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): draws of each source for each shard; columns sum to the quotas, rows differ by one at most."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    part = rng.multivariate_hypergeometric(quotas, total * left // shards, method="marginals") if total else quotas * 0
    return np.concatenate([split_draws(part, left, rng), split_draws(quotas - part, shards - left, rng)])


def _scan(block: pa.Table) -> pa.Table:
    """The documents of a block that fit into what is left, each in its turn."""
    block = block.sort_by([("key", "ascending"), ("doc_id", "ascending")])
    left, fits = block.column("left")[0].as_py(), []
    for size in block.column("size").to_pylist():
        fits.append(size <= left)
        left -= size if fits[-1] else 0
    return block.filter(pa.array(fits)).select(["s", "key", "doc_id", "size"])


def _run(block: pa.Table) -> pa.Table:
    """The documents of a block before the first that does not fit into what is left."""
    block = block.sort_by([("key", "ascending"), ("doc_id", "ascending")])
    fits = np.cumsum(block.column("size").to_numpy()) <= block.column("left")[0].as_py()
    return block.filter(pa.array(fits)).select(["s", "key", "doc_id", "size"])


def filled(units: DataFrame, rooms: dict[int, tuple[int, int]]) -> tuple[DataFrame, dict[int, int]]:
    """(s, key, doc_id, size) of the documents that fill each source's room from the block after the given rank on, and what is missing then.

    A round passes over the documents that fit at all: the blocks before the one in which the room ends go in whole, that one is scanned.
    What a block does not give then never fits again, so each round begins after it and the last one leaves no document that fits.
    """
    spark = units.sparkSession
    found, gaps, open_ = units.where(F.lit(False)).select("s", "key", "doc_id", "size"), {s: room for s, (room, _) in rooms.items()}, dict(rooms)
    while open_:
        state = spark.createDataFrame([(s, gap, after) for s, (gap, after) in open_.items()], "s int, gap long, after long")
        live = units.join(F.broadcast(state), "s").where("rank > after AND size <= gap")
        ends = live.groupBy("s", "rank", "gap").agg(F.sum("size").alias("total")).withColumn("upto", F.sum("total").over(Window.partitionBy("s").orderBy("rank")))
        stops = ends.groupBy("s").agg(F.min(F.when(F.col("upto") > F.col("gap"), F.col("rank"))).alias("stop"), F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("got")).collect()
        if not stops:
            break
        state = spark.createDataFrame([(r["s"], *open_[r["s"]], r["stop"], open_[r["s"]][0] - (r["got"] or 0)) for r in stops], "s int, gap long, after long, stop long, left long")
        live = units.join(F.broadcast(state), "s").where("rank > after AND size <= gap")
        scanned = live.where("rank = stop").select("s", "key", "doc_id", "size", "left").groupBy("s").applyInArrow(_scan, found.schema)
        part = c.cut(live.where("stop IS NULL OR rank < stop").select("s", "key", "doc_id", "size").unionByName(scanned))
        for r in part.groupBy("s").agg(F.sum("size").alias("size")).collect():
            gaps[r["s"]] -= r["size"]
        found = found.unionByName(part)
        open_ = {r["s"]: (gaps[r["s"]], r["stop"]) for r in stops if r["stop"] is not None and gaps[r["s"]]}
    return found, gaps


def run_filled(units: DataFrame, rooms: dict[int, tuple[int, int]]) -> tuple[DataFrame, dict[int, int]]:
    """The same as filled(), of the documents of the first block before the first that does not fit."""
    state = units.sparkSession.createDataFrame([(s, room, after + 1) for s, (room, after) in rooms.items()], "s int, left long, rank long")
    block = units.join(F.broadcast(state), ["s", "rank"]).select("s", "key", "doc_id", "size", "left")
    found = c.cut(block.groupBy("s").applyInArrow(_run, block.drop("left").schema))
    got = {r["s"]: r["size"] for r in found.groupBy("s").agg(F.sum("size").alias("size")).collect()}
    return found, {s: room - got.get(s, 0) for s, (room, _) in rooms.items()}


def closest(units: DataFrame, found: DataFrame, gaps: dict[int, int]) -> dict[int, tuple[int, int | None, int | None]]:
    """By source: how far it is from its target with the one more document that comes closest, and key and doc_id of that, if any."""
    rest = units.join(found.select(*(F.col(n).alias(f"fit_{n}") for n in ("s", "key", "doc_id"))), _is_fit(), "left_anti")
    missing = units.sparkSession.createDataFrame([*gaps.items()], "s int, gap long")
    near = F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("key"), F.col("doc_id"))).alias("near")
    nearest = {r["s"]: r["near"] for r in rest.join(F.broadcast(missing), "s").groupBy("s").agg(near).collect()}
    return {s: (*nearest[s],) if s in nearest and nearest[s]["off"] < gap else (gap, None, None) for s, gap in gaps.items()}


def _exchange(group: pa.Table) -> pa.Table:
    """The documents of a source whose exchange brings it nearest to its target: of all sets the fewest documents, then the first set."""
    group = group.sort_by([("one_more", "ascending"), ("key", "ascending"), ("doc_id", "ascending")])
    change = np.where(np.asarray(group.column("one_more")), -1, 1) * np.asarray(group.column("size"))
    sums, count = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for x in change:
        sums, count = np.concatenate([sums, sums + x]), np.concatenate([count, count + 1])
    off = np.abs(group.column("gap")[0].as_py() - sums)
    near = np.flatnonzero(off == off.min())
    best = int(near[count[near].argmin()])
    return group.filter(pa.array([bool(best >> i & 1) for i in range(len(change))])).select(["s", "key", "doc_id"])


def exchanged(rows: DataFrame, cap: int) -> DataFrame:
    """(s, key, doc_id) of the documents whose extra take is given to another or taken away. rows: s, key, doc_id, size, rest, whole, one_more."""
    gap = rows.groupBy("s").agg((F.first("rest") - F.sum(F.when(F.col("one_more"), F.col("size")).otherwise(0))).alias("gap")).where("gap <> 0")
    # rows that repeat a doc_id are taken alike
    units = rows.where((F.col("size") > 0) & (F.col("whole") < cap)).groupBy("s", "one_more", "key", "doc_id").agg(F.sum("size").alias("size"))
    first = F.row_number().over(Window.partitionBy("s", "one_more").orderBy("key", "doc_id"))
    some = units.withColumn("place", first).where(F.col("place") <= SWAPPED).join(gap, "s").select("s", "one_more", "key", "doc_id", "size", "gap")
    return some.groupBy("s").applyInArrow(_exchange, some.select("s", "key", "doc_id").schema)


def _is_fit() -> Column:
    return (F.col("s") == F.col("fit_s")) & (F.col("key") == F.col("fit_key")) & F.col("doc_id").eqNullSafe(F.col("fit_doc_id"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shards: int = SHARDS, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and draws: shard, epoch and place (a sort key in the shard) of each take."""
    spark = docs.sparkSession
    rows = c.cut(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(c.WORD)).cast("long").alias("size")))
    seen = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    seen = sorted(seen, key=lambda r: (r["source"] is None, r["source"] or ""))
    weigh = [weights[i % len(weights)] for i in range(len(seen))]
    aims = targets([r["size"] for r in seen], weigh, sum(r["size"] for r in seen), cap)
    whole = [int(t // r["size"]) if r["size"] else 0 for t, r in zip(aims, seen, strict=True)]
    plan = [(r["source"], i, max(8, -(-r["n"] // block_docs)), k, round(t - k * r["size"]), float(t), r["size"]) for i, (r, t, k) in enumerate(zip(seen, aims, whole, strict=True))]
    sources = spark.createDataFrame(plan, "of string, s int, n_blocks int, whole int, rest long, target double, source_size long")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    small = F.broadcast if len(plan) <= BROADCAST_SOURCES else (lambda df: df)
    rows = rows.join(small(sources), rows["source"].eqNullSafe(sources["of"])).drop("of").withColumns({"key": key, "block": F.pmod(key, "n_blocks").cast("int")})

    by_source = Window.partitionBy("s")
    order = by_source.orderBy(F.xxhash64(F.lit(seed + 1), F.col("s"), F.col("block")), "block")
    blocks = rows.groupBy("s", "block").agg(F.sum("size").alias("block_size"), F.first("rest").alias("rest"))
    blocks = blocks.withColumns({"rank": F.row_number().over(order).cast("long") - 1, "upto": F.sum("block_size").over(order)})
    blocks = blocks.select("s", "block", "rank", F.when(F.col("upto") <= F.col("rest"), "all").when(F.col("upto") - F.col("block_size") < F.col("rest"), "some").otherwise("none").alias("extra"), (F.col("rest") - F.col("upto") + F.col("block_size")).alias("room"))
    blocks = c.cut(blocks)

    drawn = {r["s"]: r for r in blocks.groupBy("s").agg(F.count("*").alias("n"), F.count_if(F.col("extra") != "none").alias("more"), F.max(F.when(F.col("extra") == "some", F.col("rank"))).alias("last"), F.max(F.when(F.col("extra") == "some", F.col("room"))).alias("room")).collect()}
    quotas = np.array([k * drawn[i]["n"] + drawn[i]["more"] for i, k in enumerate(whole)], np.int64)
    split = split_draws(quotas, shards, np.random.default_rng(seed)) if len(quotas) else np.zeros((shards, 0), np.int64)
    ends = [(i, drawn[i]["n"], drawn[i]["last"] if drawn[i]["last"] is not None else max(0, drawn[i]["more"] - 1), [int(x) for x in np.cumsum(split[:, i])]) for i in range(len(plan))]
    ends = spark.createDataFrame(ends, "s int, in_source long, last long, shard_ends array<long>")

    rows = rows.join(blocks, ["s", "block"])
    # rows that repeat a doc_id are taken alike, so they fit together or not at all
    units = rows.where((F.col("extra") != "all") & (F.col("size") > 0) & (F.col("whole") < cap)).groupBy("s", "rank", "key", "doc_id").agg(F.sum("size").alias("size"))
    units = c.cut(units)
    rooms = {i: (r["room"], r["last"] - 1) for i, r in drawn.items() if r["room"]}
    (fits, gaps), (run, run_gaps) = filled(units, rooms), run_filled(units, rooms)
    ways = [closest(units, fits, gaps), closest(units, run, run_gaps)]
    pick = {i: int(ways[1][i][0] < ways[0][i][0]) for i in rooms}
    picked = spark.createDataFrame([(i, k, *ways[k][i][1:]) for i, k in pick.items()], f"s int, way int, near_key long, near_id {units.schema['doc_id'].dataType.simpleString()}")
    fits = fits.withColumn("way", F.lit(0)).unionByName(run.withColumn("way", F.lit(1))).join(F.broadcast(picked), ["s", "way"])
    rows = rows.join(fits.select(*(F.col(n).alias(f"fit_{n}") for n in ("s", "key", "doc_id"))), _is_fit(), "left")
    rows = rows.withColumn("fitted", F.col("extra") == "all").join(F.broadcast(picked.drop("way")), "s", "left")
    near_is_it = F.coalesce((F.col("key") == F.col("near_key")) & F.col("doc_id").eqNullSafe(F.col("near_id")), F.lit(False))
    rows = c.cut(rows.withColumn("one_more", F.col("fitted") | F.col("fit_key").isNotNull() | near_is_it).drop("fit_s", "fit_key", "fit_doc_id", "near_key", "near_id"))
    flips = exchanged(rows, cap)
    rows = rows.join(flips.select(*(F.col(n).alias(f"fit_{n}") for n in ("s", "key", "doc_id"))), _is_fit(), "left")
    rows = rows.withColumn("one_more", F.col("one_more") != F.col("fit_key").isNotNull()).join(small(ends), "s")

    epochs = F.sequence(F.lit(0), F.col("whole") + F.col("one_more").cast("int") - 1)
    epochs = F.when(F.col("whole") + F.col("one_more").cast("int") > 0, epochs).otherwise(F.array().cast("array<int>"))
    rank = lambda e: F.when((e == F.col("whole")) & ~F.col("fitted"), F.col("last")).otherwise(F.col("rank"))
    shard = lambda e: F.size(F.filter("shard_ends", lambda x: x <= e * F.col("in_source") + rank(e)))
    draws = F.transform(epochs, lambda e: F.struct(shard(e).alias("shard"), e.alias("epoch"), F.xxhash64(F.lit(seed + 2), e, F.col("doc_id")).alias("place")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("one_more").cast("int"))).alias("taken"), draws.alias("draws"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and the shard of each take."""
    found = mix(c.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))
