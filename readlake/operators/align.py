"""Global alignment of reads to the cores of their clusters, and cores corrected by what their members differ in.

An edit is (pos, base): at a 0-based place of the core a read has another base, none (`-`), or more bases before it (`+` and the bases). The
default alignment is banded and runs over all pairs of an Arrow batch at a time; of cheapest alignments it takes, from the end, a kept or
changed base before a lost one before one more. Pairs with more than `band` edits are too far apart and have none. Any function of core and
read that gives such a list may take its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 12
Edits = list[tuple[int, str]]
AlignFn = Callable[[str, str], Edits]
LOST, MORE = "-", "+"


def _matrix(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(size.max(initial=0)) + 1), pad, np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out[np.repeat(np.arange(len(texts)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def banded(cores: list[str], reads: list[str], band: int = BAND) -> list[Edits | None]:
    """Edits of each pair, in order; None for pairs with more than `band` of them."""
    n = len(cores)
    if not n:
        return []
    (a, la), (b, lb) = _matrix(cores, -1), _matrix(reads, -2)
    width, far = 2 * band + 1, 1 << 20
    k = np.arange(width)
    cost = np.full((int(la.max()) + 1, n, width), far, np.int32)  # cost[i, pair, j - i + band]
    for i in range(len(cost)):
        j = i + k - band
        inside = (j >= 0) & (j[None, :] <= lb[:, None]) & (i <= la)[:, None]
        if i == 0:
            row = np.where(j >= 0, j, far)[None, :] + np.zeros((n, 1), np.int64)
        else:
            at = np.clip(j - 1, 0, b.shape[1] - 1)
            row = cost[i - 1] + (a[:, i - 1 : i] != b[:, at]) + np.where(j >= 1, 0, far)
            row[:, :-1] = np.minimum(row[:, :-1], cost[i - 1][:, 1:] + 1)
        row = np.where(inside, row, far)
        row = np.minimum.accumulate(row - k, axis=1) + k  # bases more than the core has
        cost[i] = np.where(inside, np.minimum(row, far), far)
    end = lb - la + band
    ok = (end >= 0) & (end < width)
    total = np.full(n, far)
    total[ok] = cost[la[ok], np.flatnonzero(ok), end[ok]]
    out: list[Edits | None] = [[] if t <= band else None for t in total]
    p = np.flatnonzero((total <= band) & (la + lb > 0))
    i, j = la[p].copy(), lb[p].copy()
    while len(p):
        here = cost[i, p, j - i + band]
        kk = j - i + band
        both = (i > 0) & (j > 0)
        differs = a[p, np.maximum(i - 1, 0)] != b[p, np.maximum(j - 1, 0)]
        straight = both & (cost[np.maximum(i - 1, 0), p, kk] + differs == here)
        lost = ~straight & (i > 0) & (kk + 1 < width) & (cost[np.maximum(i - 1, 0), p, np.minimum(kk + 1, width - 1)] + 1 == here)
        more = ~straight & ~lost
        for x in np.flatnonzero((straight & differs) | lost | more):
            edit = (int(i[x]), MORE + reads[p[x]][j[x] - 1]) if more[x] else (int(i[x]) - 1, LOST if lost[x] else reads[p[x]][j[x] - 1])
            out[p[x]].append(edit)
        i, j = i - (straight | lost), j - (straight | more)
        live = (i > 0) | (j > 0)
        p, i, j = p[live], i[live], j[live]
    return [None if e is None else _joined(e[::-1]) for e in out]


def _joined(edits: Edits) -> Edits:
    """Bases more at one place are one edit."""
    out: Edits = []
    for pos, base in edits:
        if out and base[0] == MORE and out[-1][0] == pos and out[-1][1][0] == MORE:
            out[-1] = (pos, out[-1][1] + base[1:])
        else:
            out.append((pos, base))
    return out


def aligned(pairs: DataFrame, align_fn: AlignFn | None = None, band: int = BAND) -> DataFrame:
    """cluster_id, read_id, edits (null: too far apart) of pairs (cluster_id, read_id, core, seq). A null core or seq is too far from all."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("pos", pa.int32()), ("base", pa.string())]))
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                cores, seqs = part.column("core").to_pylist(), part.column("seq").to_pylist()
                known = [i for i, (c, s) in enumerate(zip(cores, seqs, strict=True)) if c is not None and s is not None]
                some = [cores[i] for i in known], [seqs[i] for i in known]
                found = banded(*some, band) if align_fn is None else [align_fn(c, s) for c, s in zip(*some, strict=True)]
                edits: list = [None] * part.num_rows
                for i, e in zip(known, found, strict=True):
                    edits[i] = None if e is None else [{"pos": pos, "base": base} for pos, base in e]
                yield pa.record_batch([part.column("cluster_id"), part.column("read_id"), pa.array(edits, struct)], ["cluster_id", "read_id", "edits"])

    schema = f"cluster_id {kinds['cluster_id']}, read_id {kinds['read_id']}, edits array<struct<pos: int, base: string>>"
    return pairs.select("cluster_id", "read_id", "core", "seq").mapInArrow(run, schema)


def edited(core: Column, edits: Column) -> Column:
    """The core after edits (pos, base), of which none but one more base stands at a place that another changes."""
    order = F.reverse(F.array_sort(F.transform(edits, lambda e: F.struct(e["pos"].alias("pos"), (~e["base"].startswith(MORE)).cast("int").alias("kind"), e["base"].alias("base")))))
    more, lost = lambda e: e["base"].startswith(MORE), lambda e: e["base"] == LOST
    base = lambda e: F.when(more(e), F.substring(e["base"], 2, 1 << 30)).when(lost(e), "").otherwise(e["base"])
    return F.aggregate(order, core, lambda text, e: F.concat(F.substr(text, F.lit(1), e["pos"]), base(e), F.substr(text, e["pos"] + F.when(more(e), 1).otherwise(2))))


def corrected(members: DataFrame, align_fn: AlignFn | None = None, least: int = 5, share: float = 0.5, band: int = BAND) -> DataFrame:
    """cluster_id, core, n_members, n_edits: cores after every edit that more than `least` and more than `share` of the aligned members have.

    members: cluster_id, read_id, core, seq. Edits are counted with map-side combine, so that a cluster of any size is no one's task.
    """
    found = aligned(members, align_fn, band).where("edits IS NOT NULL")
    voices = found.groupBy("cluster_id").agg(F.count("*").alias("n_members"))
    votes = found.select("cluster_id", F.explode("edits").alias("e")).groupBy("cluster_id", "e.pos", F.col("e.base").startswith(MORE).alias("more"), "e.base").agg(F.count("*").alias("n"))
    # over half of the members: one edit at a place, and one of more bases before it
    best = votes.groupBy("cluster_id", "pos", "more").agg(F.min(F.struct((-F.col("n")).alias("m"), "base")).alias("b"))
    won = best.join(voices, "cluster_id").where((-F.col("b.m") > least) & (-F.col("b.m") > share * F.col("n_members")))
    edits = won.groupBy("cluster_id").agg(F.collect_list(F.struct("pos", F.col("b.base").alias("base"))).alias("edits"))
    cores = members.groupBy("cluster_id").agg(F.min("core").alias("core")).join(voices, "cluster_id", "left").join(edits, "cluster_id", "left")
    core = F.when(F.col("edits").isNull(), F.col("core")).otherwise(edited(F.col("core"), F.col("edits")))
    return cores.select("cluster_id", core.alias("core"), F.coalesce("n_members", F.lit(0)).cast("long").alias("n_members"), F.coalesce(F.size("edits"), F.lit(0)).alias("n_edits"))
