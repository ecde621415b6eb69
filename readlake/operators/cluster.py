"""Clustering of reads by anchor similarity: online, in order of arrival, per prefix partition; and in batch, free of order.

Online, a read joins the first cluster whose head anchor differs in fewer than `near` places, else by its tail anchor, else by the best of its
inner anchors over the vertical drifts. If some founder's inner anchor then differs in fewer than `far` places, each of them followed
by two equal bases as far as there are any, the read is ambiguous; else it founds a cluster. Reads stream through a task prefix by
prefix; what is held is the anchors of the founders of the current prefix. `streaming.clusters` does the same over micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.operators import align
from readlake.operators.anchors import AnchorIndex, AnchorTable, Coder, differing, spaced
from readlake.operators.match import chosen, founders, near_cores, slot_pairs
from readlake.session import keep


@dataclass(frozen=True)
class ClusterConfig:
    """length: of reads; depth, inner_depth: of the end and inner anchors; near: differences that don't join; far: differences in
    the inner anchors that are not ambiguous any more; drift: vertical drift of inner anchors; head_skip, tail_skip: primers;
    inner_head, inner_tail: where the inner anchors begin, from the head, and from the tail; inner_slots: 0, 1 or 2 of them;
    prefix: bases that tell partitions apart, from head_skip on; min_slack: bases that a read may lack; least: of members, of clusters that are returned."""

    length: int = 150
    depth: int = 15
    near: int = 3
    far: int = 8
    drift: int = 3
    prefix: int = 0
    min_slack: int = 5
    alphabet: str = "ACGT"
    inner_depth: int | None = None
    inner_head: int = 40
    inner_tail: int = 40
    inner_slots: int = 2
    head_skip: int = 0
    tail_skip: int = 0
    least: int = 1
    coder: Coder = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "coder", Coder(self.alphabet))

    @property
    def inner(self) -> int:
        return self.depth if self.inner_depth is None else self.inner_depth

    @property
    def moves(self) -> list[int]:
        return [*range(-self.drift, self.drift + 1)]

    def begin(self, slot: str, move: int = 0) -> int:
        """Where a head or inner anchor begins."""
        return {"a": self.head_skip, "c": self.head_skip + self.inner_head - move, "d": self.length - 2 - self.inner_tail - self.tail_skip - move}[slot]

    @property
    def inner_names(self) -> str:
        return "cd"[: self.inner_slots]

    def codes(self, seqs: list[str]) -> np.ndarray:
        """(reads, slots): head, tail, then the inner slots of each move."""
        flat, at = self.coder.flat(seqs)
        size = np.diff(at)
        cols = [self.coder.windows(flat, at, np.full(len(seqs), self.begin("a")), self.depth), self.coder.windows(flat, at, size - self.depth - self.tail_skip, self.depth)]
        cols += [self.coder.windows(flat, at, np.full(len(seqs), self.begin(slot, move)), self.inner) for move in self.moves for slot in self.inner_names]
        return np.stack(cols, axis=1)


class OnlineClusters:
    """State of one prefix: anchors of the founders by slot, and the inner anchors of all founders.

    Reads are placed in blocks. A block is looked up at once in ordered tables of earlier founders. What founders since then can change, reads
    that have joined none, and reads near such a read that comes before them, are placed one by one, the latest founders being in `slots`.
    """

    BLOCK, LATEST = 4096, 64
    #: reads whose anchors are coded at a time
    CODED = 16_384

    def __init__(self, cfg: ClusterConfig):
        self.cfg = cfg
        #: half as wide where a number fits; 0 for none
        self.number = np.uint32 if cfg.coder.bits * cfg.inner < 32 else np.int64
        self.inner = {s: np.zeros(64, self.number) for s in cfg.inner_names}
        self.founders = 0
        #: the slot of each inner column of codes, and the columns of each slot
        self.columns = [s for _ in cfg.moves for s in cfg.inner_names]
        self.columns_of = {"a": [0], "b": [1], **{s: [2 + k for k, x in enumerate(self.columns) if x == s] for s in cfg.inner_names}}
        self.still = 2 + len(cfg.inner_names) * cfg.moves.index(0)
        self.tables = {s: self._table(s, np.zeros(0, np.int64)) for s in "ab" + cfg.inner_names}
        self.owners = {s: np.zeros(0, object) for s in self.tables}
        self._forget()

    def _table(self, slot: str, codes: np.ndarray) -> AnchorTable:
        return AnchorTable(codes, self.cfg.near, self.cfg.depth if slot in "ab" else self.cfg.inner, self.cfg.coder)

    def _forget(self) -> None:
        self.slots = {s: AnchorIndex(self.cfg.near, self.cfg.coder) for s in self.tables}
        self.latest: list[tuple[object, dict[str, int]]] = []

    def _anchors(self, codes: list[int]) -> dict[str, int]:
        """Those without drift."""
        return {"a": codes[0], "b": codes[1], **dict(zip(self.cfg.inner_names, codes[self.still :], strict=False))}

    def _fold(self) -> None:
        """The latest founders go into the tables, when they are many; of equal anchors the last one counts."""
        if len(self.latest) < max(self.LATEST, self.founders // 8):
            return
        for slot, table in self.tables.items():
            new = [(own[slot], i) for i, own in self.latest if own[slot] >= 0]
            codes = np.concatenate([np.array([x for x, _ in new[::-1]], np.int64), table.codes])
            owners = np.empty(len(codes), object)
            owners[: len(new)] = [i for _, i in new[::-1]]
            owners[len(new) :] = self.owners[slot]
            codes, first = np.unique(codes, return_index=True)
            self.tables[slot], self.owners[slot] = self._table(slot, codes), owners[first]
        self._forget()

    def found(self, read_id: object, codes: list[int]) -> None:
        """The read is a founder: its anchors without drift are entered."""
        anchors = self._anchors(codes)
        for slot, code in anchors.items():
            if code >= 0:
                self.slots[slot].insert(code, read_id)
        for slot in self.cfg.inner_names:
            if self.founders == len(self.inner[slot]):
                self.inner[slot] = np.concatenate([self.inner[slot], np.zeros_like(self.inner[slot])])
            self.inner[slot][self.founders] = max(anchors[slot], 0)
        self.founders += 1
        self.latest.append((read_id, anchors))

    def _doubtful(self, codes: list[int]) -> bool:
        """Whether an inner anchor of some founder differs in fewer than `far` spaced places."""
        cfg, bits = self.cfg, self.cfg.coder.bits
        for slot in cfg.inner_names:
            own = np.array([c for s, c in zip(self.columns, codes[2:], strict=True) if s == slot and c >= 0], self.number)
            theirs = self.inner[slot][: self.founders]
            theirs = theirs[theirs > 0]
            for a in range(0, len(theirs), 4096):
                off = differing(theirs[a : a + 4096, None] ^ own, bits, cfg.inner)
                if spaced(off[np.bitwise_count(off) < cfg.far], bits).any():
                    return True
        return False

    def _known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(off, at), both (reads, columns): differences from the nearest anchor in the tables, and where it is. A column is asked only where none before it decides."""
        near, off, at = self.cfg.near, np.full(codes.shape, self.cfg.near, np.int64), np.zeros(codes.shape, np.int64)
        for slot, cols in self.columns_of.items():
            cells = np.ix_(np.flatnonzero((off[:, : min(cols[0], 2)] >= near).all(axis=1)), cols)
            found, n = self.tables[slot].nearest(codes[cells].ravel())
            at[cells], off[cells] = found.reshape(-1, len(cols)), n.reshape(-1, len(cols))
        return off, at

    def _changeable(self, codes: np.ndarray, off: np.ndarray, hopeful: np.ndarray) -> np.ndarray:
        """Reads with an anchor near one of the latest founders, or of a hopeful read before them, in a column that may decide."""
        near, out = self.cfg.near, np.zeros(len(codes), bool)
        order = np.concatenate([np.full(len(self.latest), -1), hopeful])
        for slot, cols in self.columns_of.items():
            own = self.still + self.cfg.inner_names.find(slot) if cols[0] > 1 else cols[0]
            table = self._table(slot, np.concatenate([np.array([x[slot] for _, x in self.latest], np.int64), codes[hopeful, own]]))
            # what is equal to an anchor of the head stays with it; a slot before this one decides without it
            todo = np.flatnonzero((off[:, : min(cols[0], 2)] >= near).all(axis=1) & ((off[:, 0] > 0) | (cols[0] > 0)) & ~out)
            for row, place, _ in table.pairs(codes[np.ix_(todo, cols)].ravel()):
                row = todo[row // len(cols)]
                out[row[order[table.places[place]] < row]] = True
        return out

    def _place_one(self, codes: list[int], off: list[int], at: list[int]) -> object | None:
        """The cluster of a read by tables and latest founders; None if it joins none."""
        near, best = self.cfg.near, (self.cfg.near, None)
        for k, slot in enumerate(["a", "b", *self.columns]):
            if k in (1, 2) and best[0] < near:
                break
            n, who = off[k], self.owners[slot][at[k]] if off[k] < near else None
            m, anchor = self.slots[slot].best(codes[k])
            if m < near and (m < n or (m == n and anchor <= self.tables[slot].codes[at[k]])):
                n, who = m, self.slots[slot].exact[anchor]
            if n < best[0]:
                best = (n, who)
        return best[1]

    def _place_block(self, ids: list, codes: np.ndarray) -> list[tuple[object | None, str]]:
        self._fold()
        near = self.cfg.near
        off, at = self._known(codes)
        joined = (off < near).any(axis=1)
        changeable = self._changeable(codes, off, np.flatnonzero(~joined))
        # head, else tail, else the first of the inner columns with the fewest differences
        column = np.where(off[:, 0] < near, 0, np.where(off[:, 1] < near, 1, 2 + off[:, 2:].argmin(axis=1) if off.shape[1] > 2 else 1))
        who = np.full(len(ids), None, object)
        for k, slot in enumerate(["a", "b", *self.columns]):
            some = np.flatnonzero(joined & (column == k))
            who[some] = self.owners[slot][at[some, k]]
        out = [(x, "joined") for x in who]
        for i in np.flatnonzero(~joined | changeable).tolist():
            own = codes[i].tolist()
            if changeable[i] and (found := self._place_one(own, off[i].tolist(), at[i].tolist())) is not None:
                out[i] = (found, "joined")
            elif self._doubtful(own):
                out[i] = (None, "ambiguous")
            else:
                self.found(ids[i], own)
                out[i] = (ids[i], "founder")
        return out

    def place_all(self, ids: list, seqs: list[str]) -> list[tuple[object | None, str]]:
        """(cluster, status) of reads in order: joined, founder or ambiguous."""
        out = []
        for first in range(0, len(ids), self.CODED):
            codes = self.cfg.codes(seqs[first : first + self.CODED])
            while len(out) < first + len(codes):
                a = len(out) - first
                b = min(len(codes), a + min(self.BLOCK, max(512, self.founders)))
                out += self._place_block(ids[first + a : first + b], codes[a:b])
        return out

    def restore(self, known: Iterable[tuple[object, str]]) -> None:
        """Founders (read_id, seq) of before, in order of arrival; they go into the tables as they come, not all at once."""
        known = iter(known)
        while some := [*islice(known, self.CODED)]:
            for (read_id, _), codes in zip(some, self.cfg.codes([seq for _, seq in some]), strict=True):
                self.found(read_id, codes.tolist())
            self._fold()

    def place(self, read_id: object, seq: str) -> tuple[object | None, str]:
        return self.place_all([read_id], [seq])[0]


def admit(reads: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """Long enough, and only letters of the alphabet."""
    return reads.where((F.length("seq") >= cfg.length - cfg.min_slack) & F.col("seq").rlike(f"^[{cfg.alphabet}]*$"))


def prefixed(reads: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """read_id, prefix, seq of the reads that are admitted."""
    return admit(reads, cfg).select("read_id", F.substring("seq", cfg.head_skip + 1, cfg.prefix).alias("prefix"), "seq")


def large(assigned: DataFrame, least: int) -> DataFrame:
    """Assignments of the clusters with at least so many members; what is in none has no cluster."""
    if least <= 1:
        return assigned
    small = assigned.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") < least)
    return assigned.join(small.select("cluster_id"), "cluster_id", "left_anti").select(*assigned.columns)


def online(reads: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """(read_id, cluster_id, status), faithful to the order of read_id inside each prefix; prefixes never meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, state = None, None
        for batch in batches:
            ids, seqs, prefixes = (batch.column(n).to_pylist() for n in ("read_id", "seq", "prefix"))
            cuts = [0, *(i for i in range(1, len(ids)) if prefixes[i] != prefixes[i - 1]), len(ids)]
            out: list[tuple] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if state is None or prefixes[a] != prefix:
                    prefix, state = prefixes[a], OnlineClusters(cfg)
                out += state.place_all(ids[a:b], seqs[a:b])
            if out:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], ["read_id", "cluster_id", "status"])

    rows = prefixed(reads, cfg).repartition("prefix").sortWithinPartitions("prefix", "read_id")
    return large(rows.mapInArrow(run, "read_id long, cluster_id long, status string"), cfg.least)


def cluster(reads: DataFrame, cfg: ClusterConfig = ClusterConfig(), slots: str = "a") -> DataFrame:
    """(read_id, cluster_id), free of order and of prefixes: a read joins an earlier one by anchors within near - 1 differences, by blocked joins.

    slots: which anchors are tried, of a (head), b (tail), c and d (inner, over the drifts). The head comes before the tail and that before
    the inner ones; of those the fewest differences, and then the least read_id, decide. Not transitive.
    """
    rows = admit(reads, cfg)
    if slots == "a" and not cfg.head_skip:
        return large(founders(slot_pairs(rows, cfg, "a"), rows), cfg.least)
    return large(chosen(slot_pairs(rows, cfg, slots), rows), cfg.least)


def cluster_corrected(reads: DataFrame, cfg: ClusterConfig = ClusterConfig(), slots: str = "a", rounds: int = 1, align_fn: align.AlignFn | None = None, least: int = 5, whole_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Assignments (read_id, cluster_id) and cores (cluster_id, core, n_members, n_edits): after clustering, the founders' reads are corrected by
    the alignments of their members (whole_only: of those of full length), the anchors of corrected cores are looked up by the reads that are alone, and
    so on for some rounds."""
    heard = lambda joined, core: joined.join(rows, "read_id").join(core, "cluster_id").withColumn("seq", F.when((F.length("seq") == cfg.length) | F.lit(not whole_only), F.col("seq")))
    rows = keep(admit(reads, cfg).select("read_id", "seq"))
    joined = keep(cluster(rows, cfg, slots))
    core = rows.select(F.col("read_id").alias("cluster_id"), F.col("seq").alias("core"))
    for _ in range(rounds):
        cores = keep(align.corrected(heard(joined, core), align_fn, least))
        size = joined.groupBy("cluster_id").agg(F.count("*").alias("n"))
        alone = rows.join(size.where("n = 1").select(F.col("cluster_id").alias("read_id")), "read_id", "left_semi")
        found = near_cores(alone, cores.where("n_edits > 0").select("cluster_id", "core"), cfg)
        joined = keep(joined.join(found.select("read_id", F.col("cluster_id").alias("new")), "read_id", "left").select("read_id", F.coalesce("new", "cluster_id").alias("cluster_id")))
        core = cores.select("cluster_id", "core")
    cores = align.corrected(heard(joined, core), align_fn, least)
    return joined, cores


def corrected_cores(members: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """(cluster_id, core): the founder's head anchor after correction. members: cluster_id, core, anchor, one row for each member.

    A place of a core is corrected to the base that most mismatching members have there (ties to the least base) if it has more than
    `least` mismatches and more than `share` of all mismatches of the cluster. Only as many characters as core and anchor share are compared.
    """
    places = members.select("cluster_id", "core", "anchor", F.explode_outer(F.sequence(F.lit(1), F.least(F.length("core"), F.length("anchor")))).alias("pos"))
    base = F.substr("anchor", F.col("pos"), F.lit(1))
    off = places.where(base != F.substr("core", F.col("pos"), F.lit(1))).groupBy("cluster_id", "pos", base.alias("base")).agg(F.count("*").alias("n"))
    at = off.groupBy("cluster_id", "pos").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), "base")).alias("best"))
    every = at.groupBy("cluster_id").agg(F.sum("n").alias("total"))
    wrong = at.join(every, "cluster_id").where((F.col("n") > least) & (F.col("n") > share * F.col("total")))
    # more than half of all mismatches: one place at most, where share is a half or more
    fixed = wrong.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "pos", F.col("best.base").alias("base"))).alias("f"))
    cores = members.groupBy("cluster_id").agg(F.min("core").alias("core")).join(fixed, "cluster_id", "left")
    core = F.concat(F.substr("core", F.lit(1), F.col("f.pos") - 1), F.col("f.base"), F.substr("core", F.col("f.pos") + 1))
    return cores.select("cluster_id", F.when(F.col("f").isNull(), F.col("core")).otherwise(core).alias("core"))
