"""Inner anchors of a read come from one row of it, whatever the drifts."""

from readlake.operators import match
from readlake.operators.cluster import ClusterConfig


def test_windows_inside_each_once(spark):
    reads = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACG"), (3, "AAAAAAA"), (4, None), (5, "TTACG")], "read_id long, seq string")
    got = match._moved_anchors(reads, match._Keys(1, 4, 3), [0, 1, 2, 5])
    assert sorted(map(tuple, got.collect())) == [(1, "ACGT"), (1, "CGTA"), (3, "AAAA"), (5, "TACG"), (5, "TTAC")]


def test_no_join_for_each_drift(spark):
    reads = spark.createDataFrame([(k, "ACGTTGCA" * 19) for k in range(4)], "read_id long, seq string")
    plan = match.slot_pairs(reads, ClusterConfig(length=152))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Union") == 1
