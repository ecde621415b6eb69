"""Clustering over micro-batches against one run in the same order."""

import random

import numpy as np
from pyspark.sql import functions as F

from readlake.operators import match
from readlake.operators.anchors import AnchorIndex, AnchorTable, Coder, differing
from readlake.operators.cluster import ClusterConfig, OnlineClusters, cluster, online
from readlake.streaming import clusters


def noisy(n, refs=8, seed=1, length=150, rate=0.03):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(refs)]
    return [(i, "".join(rng.choice("ACGT") if rng.random() < rate else x for x in rng.choice(base))) for i in range(n)]


def test_chunks_give_what_one_run_gives(spark, tmp_path):
    rows = noisy(240)
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    cfg = ClusterConfig(prefix=1)
    got = clusters.in_chunks(reads, str(tmp_path / "s"), cfg, 3)
    assert got.select("epoch").distinct().count() == 3
    assert sorted(map(tuple, got.select("read_id", "cluster_id", "status").collect()), key=str) == sorted(map(tuple, online(reads, cfg).collect()), key=str)
    joined = got.where("status = 'joined'")
    assert joined.where("cluster_id >= read_id").count() == 0
    # some join founders of an earlier epoch
    founders = got.where("status = 'founder'").select(F.col("read_id").alias("cluster_id"), F.col("epoch").alias("founded"))
    assert joined.join(founders, "cluster_id").where("epoch > founded").count() > 0


def test_restart_assigns_nothing_twice(spark, tmp_path):
    """An epoch whose commit is lost is run again, from the state of the epoch before."""
    root = str(tmp_path / "s")
    reads = spark.createDataFrame(noisy(90, seed=2), "read_id long, seq string")
    before = sorted(map(tuple, clusters.in_chunks(reads, root, chunks=2).collect()), key=str)
    commits = sorted((tmp_path / "s" / "checkpoint" / "commits").glob("[0-9]*"))
    for f in (commits[-1], commits[-1].parent / f".{commits[-1].name}.crc"):
        f.unlink(missing_ok=True)
    stream = spark.readStream.schema("read_id long, seq string").parquet(f"{root}/in/*")
    clusters.start(stream, root).awaitTermination()
    clusters.start(stream, root).awaitTermination()  # nothing new
    assert sorted(map(tuple, clusters.assigned(spark, root).collect()), key=str) == before


def plain_nearest(anchor, known, near):
    """(cluster, differences) by comparing all."""
    off = [(sum(x != y for x, y in zip(a, anchor)), a, c) for a, c in known.items() if len(a) == len(anchor)]
    return next(((c, n) for n, a, c in sorted(off) if n < near), (None, near))


def test_index_finds_the_nearest(spark):
    rng = random.Random(5)
    index, known = AnchorIndex(3, Coder("ACGT")), {}
    for i in range(400):
        anchor = "".join(rng.choice("ACGT") for _ in range(rng.choice([6, 7])))
        if i % 5 == 4:
            gone = rng.choice([*known])
            index.delete(gone)
            del known[gone]
        index.insert(anchor, i)
        known[anchor] = i
        probe = "".join(rng.choice("ACGT") for _ in range(rng.choice([6, 7])))
        assert index.nearest(probe) == plain_nearest(probe, known, 3)


def plain_online(rows, cfg):
    """As the class says, on texts."""
    slots, inner, out = {s: {} for s in "abcd"}, [], {}
    cut = lambda seq, begin: seq[begin : begin + cfg.depth] if 0 <= begin <= len(seq) - cfg.depth else None
    for i, seq in rows:
        ends = {"a": cut(seq, 0), "b": cut(seq, len(seq) - cfg.depth)}
        moved = [(s, cut(seq, cfg.begin(s, m))) for m in cfg.moves for s in "cd"]
        hit = next((x for s, a in ends.items() if (x := plain_nearest(a, slots[s], cfg.near))[1] < cfg.near), None)
        if hit is None:
            tried = [plain_nearest(a, slots[s], cfg.near) for s, a in moved if a]
            hit = min(tried, key=lambda x: x[1], default=None)
            hit = hit if hit and hit[1] < cfg.near else None
        if hit:
            out[i] = (hit[0], "joined")
            continue
        offs = [[k for k in range(cfg.depth) if a[k] != b[k]] for s, a in moved if a for t, b in inner if s == t]
        if any(len(o) < cfg.far and all(y - x > 2 for x, y in zip(o[:-1], o[1:])) for o in offs):
            out[i] = (None, "ambiguous")
            continue
        out[i] = (i, "founder")
        for s, a in {**ends, "c": cut(seq, cfg.begin("c")), "d": cut(seq, cfg.begin("d"))}.items():
            if a:
                slots[s][a] = i
                inner += [(s, a)] if s in "cd" else []
    return out


def test_online_equals_plain_texts(spark):
    cfg = ClusterConfig()
    rows = noisy(150, seed=7, rate=0.08) + [(1000 + i, s) for i, s in noisy(40, refs=40, seed=8)]
    state = OnlineClusters(cfg)
    got = dict(zip([i for i, _ in rows], state.place_all([i for i, _ in rows], [s for _, s in rows])))
    assert got == plain_online(rows, cfg)
    assert {s for _, s in got.values()} == {"joined", "founder"} or "ambiguous" in {s for _, s in got.values()}


def test_blocks_do_not_change_assignments():
    """Many small blocks, and founders that go into the tables at once or late, give what one read at a time gives."""
    rows = noisy(500, refs=25, seed=21, rate=0.05) + [(10_000 + i, s) for i, s in noisy(200, refs=60, seed=22, rate=0.1)]
    ids, seqs = [i for i, _ in rows], [s for _, s in rows]
    for cfg in (ClusterConfig(), ClusterConfig(near=2, drift=1), ClusterConfig(inner_slots=0), ClusterConfig(near=4, inner_depth=20)):
        alone = OnlineClusters(cfg)
        want = [alone.place(i, s) for i, s in rows]
        assert len({s for _, s in want}) >= 2
        for latest in (1, 64, 10**6):
            state = OnlineClusters(cfg)
            state.LATEST = latest
            assert state.place_all(ids, seqs) == want
        cuts = [0, 3, 3, 90, 400, len(rows)]
        state = OnlineClusters(cfg)
        assert [x for a, b in zip(cuts[:-1], cuts[1:]) for x in state.place_all(ids[a:b], seqs[a:b])] == want
    assert [x for x in OnlineClusters(ClusterConfig(near=0)).place_all(ids[:50], seqs[:50]) if x[1] == "joined"] == []


def test_anchor_table_finds_what_comparison_finds():
    rng, coder = random.Random(4), Coder("ACGT")
    some = ["".join(rng.choices("ACGT", k=9)) for _ in range(300)]
    codes = np.array(sorted({coder.text(x) for x in some}), np.int64)
    asked = np.array([coder.text("".join(rng.choices("ACGT", k=9))) for _ in range(200)] + [-1], np.int64)
    off = np.bitwise_count(differing(codes[None] ^ asked[:, None], 2, 9)).astype(int)
    at, n = AnchorTable(codes, 3, 9, coder).nearest(asked)
    for row, (a, m) in enumerate(zip(at, n)):
        least = off[row].min()
        assert m == (least if least < 3 and asked[row] >= 0 else 3)
        assert m == 3 or a == int(off[row].argmin())


def test_primers_small_clusters_and_other_letters(spark):
    rows = [(i, "TTTT" + s[4:146] + "GGGG") for i, s in noisy(60, seed=3)]
    cfg = ClusterConfig(head_skip=4, tail_skip=4, least=2, inner_slots=1)
    got = online(spark.createDataFrame(rows, "read_id long, seq string"), cfg).collect()
    sizes = {}
    for r in got:
        sizes[r["cluster_id"]] = sizes.get(r["cluster_id"], 0) + 1
    assert min(n for c, n in sizes.items() if c is not None) >= 2
    odd = spark.createDataFrame([(i, s.replace("A", "X").replace("C", "-")) for i, s in noisy(40, seed=3)], "read_id long, seq string")
    assert online(odd, ClusterConfig(alphabet="XGT-")).where("status = 'joined'").count() > 20


def test_slots_in_batch_follow_their_order(spark):
    """Reads that share only a tail, or only a moved inner anchor, meet; the head comes first."""
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, t = some(150), some(150)
    moved = some(38) + a[40:55] + some(97)  # its inner anchor stands two bases before
    rows = [(1, a), (2, t), (3, some(135) + t[-15:]), (4, moved), (5, a[:15] + some(120) + t[-15:])]
    got = {r["read_id"]: r["cluster_id"] for r in cluster(spark.createDataFrame(rows, "read_id long, seq string"), ClusterConfig(), "abcd").collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1, 5: 1}


def test_candidates_of_random_anchors_are_few(spark):
    """Of anchors that have nothing in common hardly any meet."""
    rng = random.Random(10)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(15))) for i in range(4000)]
    keys = match._Keys(2, 15, 5)
    each = match._distinct(match._anchors(spark.createDataFrame(rows, "read_id long, seq string"), keys, F.lit(1)), keys)
    assert match.candidates(each, each, keys).count() < 4000


def test_other_letters_and_long_anchors_meet(spark):
    """Letters that share a digit are told apart by the text, and anchors too long for a number are compared as texts."""
    rows = [(1, "ACGTXCGTACGTACG"), (2, "ACGTYCGTACGTACG"), (3, "ACGTACGTACGTACG"), (4, "XXXXXXXXXXXXXXX"), (5, "YYYYYYYYYYYYYYY")]
    got = {tuple(r) for r in match.anchor_pairs(spark.createDataFrame(rows, "read_id long, seq string")).collect()}
    assert got == {(1, 2, 1), (1, 3, 1), (2, 3, 1)}
    longer = spark.createDataFrame([(i, s * 2) for i, s in rows], "read_id long, seq string")
    assert {tuple(r) for r in match.anchor_pairs(longer, depth=30).collect()} == {(1, 2, 2), (1, 3, 2), (2, 3, 2)}
