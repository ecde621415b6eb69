"""Alignment of reads to cores, cores corrected by their members, and corrected cores in the index again."""

import random

from pyspark.sql import functions as F
from test_matching import edited, levenshtein, some

from readlake.operators import align
from readlake.operators.cluster import ClusterConfig, cluster, cluster_corrected


def applied(core, edits):
    """Edits put into the core by hand."""
    out = []
    for i in range(len(core) + 1):
        out += [b[1:] for p, b in edits if p == i and b[0] == align.MORE]
        if i < len(core):
            own = [b for p, b in edits if p == i and b[0] != align.MORE]
            out.append("" if own == [align.LOST] else own[0] if own else core[i])
    return "".join(out)


def test_alignments_are_cheapest_and_rebuild_the_read():
    rng = random.Random(1)
    cores = [some(rng, rng.choice([1, 5, 40, 90])) for _ in range(80)] + ["", "", "A"]
    reads = [edited(rng, c, rng.choice([0, 1, 2, 5])) if c else c for c in cores[:80]] + ["", "ACG", ""]
    for core, read, edits in zip(cores, reads, align.banded(cores, reads, 6)):
        away = levenshtein(core, read)
        if away > 6:
            assert edits is None
        else:
            assert applied(core, edits) == read and sum(len(b) - 1 if b[0] == align.MORE else 1 for _, b in edits) == away
    assert align.banded(["A" * 40], ["A" * 20], 6) == [None] and align.banded([], []) == []
    assert align.banded(["AAA"], ["ATA"]) == [[(1, "T")]]


def test_edits_are_applied_in_spark(spark):
    rng = random.Random(2)
    pairs = [(i, i, c := some(rng, 30), edited(rng, c, 3)) for i in range(60)] + [(60, 60, None, "A"), (61, 61, "A", None)]
    rows = spark.createDataFrame(pairs, "cluster_id long, read_id long, core string, seq string")
    got = align.aligned(rows).join(rows, ["cluster_id", "read_id"]).withColumn("again", align.edited(F.col("core"), F.col("edits"))).collect()
    assert all((r["again"] == r["seq"]) if r["cluster_id"] < 60 else r["edits"] is None for r in got) and len(got) == 62


def test_cores_are_corrected_at_several_places(spark):
    """The founder has a changed base, a lost one and two more; most members do not."""
    rng = random.Random(3)
    truth = some(rng, 60)
    core = truth[:10] + ("A" if truth[10] != "A" else "C") + truth[11:30] + truth[31:45] + "GG" + truth[45:]
    members = [(1, 0, core, core)] + [(1, i, core, edited(rng, truth, 1) if i % 3 == 0 else truth) for i in range(1, 21)] + [(2, 90, truth, truth), (3, 91, truth, some(rng, 20))]
    rows = spark.createDataFrame(members, "cluster_id long, read_id long, core string, seq string").repartition(5)
    got = {r["cluster_id"]: (r["core"], r["n_members"]) for r in align.corrected(rows).collect()}
    assert got[1][0] == truth and got[2] == (truth, 1) and got[3] == (truth, 0)


def test_alignment_can_be_replaced(spark):
    """One that sees changed bases only."""
    plain = lambda core, read: [(i, b) for i, (a, b) in enumerate(zip(core, read)) if a != b]
    rows = spark.createDataFrame([(1, i, "ACGTACGT", "ACGAACGT") for i in range(8)], "cluster_id long, read_id long, core string, seq string")
    assert align.corrected(rows, plain).first()["core"] == "ACGAACGT"


def test_corrected_cores_find_reads_that_were_alone(spark):
    """The founder's anchor has an error that no member has. A read of two other errors is too far from all of them, and near enough to the corrected core."""
    truth = some(random.Random(4), 150)
    flip = lambda *at: "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[x] if i in at else x for i, x in enumerate(truth))
    rows = [(1, flip(2))] + [(2 + k, flip(p)) for k, p in enumerate((0, 1, 3, 4, 6, 7, 8, 9, 10, 11))] + [(50, flip(5, 12))]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    cfg = ClusterConfig()
    before = {r["read_id"]: r["cluster_id"] for r in cluster(reads, cfg).collect()}
    assert before == {i: 50 if i == 50 else 1 for i, _ in rows}
    joined, cores = cluster_corrected(reads, cfg)
    assert {r["read_id"]: r["cluster_id"] for r in joined.collect()} == {i: 1 for i, _ in rows}
    assert {r["cluster_id"]: r["core"] for r in cores.collect()} == {1: truth}
