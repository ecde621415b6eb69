"""Evidence is summed up where it is made: a read meets its weight whole, and the texts are cut into reads once."""

from readlake.operators import decode
from readlake.plans import catalogue

D = "/root/testdata/sf0.001"


def test_reads_meet_weights_before_they_are_cut(spark):
    reads = spark.createDataFrame([(k, k % 2, "ACGT", 1.0, True) for k in range(8)], "read_id long, label int, seq string, strength double, high_conf boolean")
    plan = decode.fused_counts(reads, decode.read_weights(reads))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Join")


def test_texts_are_not_read_again(spark):
    assert "FileScan" not in catalogue._labelled_reads(spark, D)._jdf.queryExecution().executedPlan().toString()
