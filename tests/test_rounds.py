import pytest

from readlake.operators import batches, metrics
from readlake.operators.scorer import kmer_embedding, kmers
from readlake.plans import rounds
from readlake.sources import simulate, sinks
from pyspark.sql import functions as F


@pytest.mark.parametrize("partitions", [1, 4, 8])
def test_rounds_mend_wrong_labels_and_resume(spark, tmp_path, partitions):
    refs = simulate.references(spark, 3, 120)
    reads = simulate.substitution_channel(refs, 20, 0.0, 0.02).repartition(partitions).cache()
    wrong = F.when(F.col("read_id") % 10 == 1, F.col("label") % 3 + 1).otherwise(F.col("label"))
    start = reads.select("read_id", wrong.cast("int").alias("label"))
    root = str(tmp_path / "r")
    done = rounds.iterate(reads.select("read_id", "seq"), start, root, 2).cache()
    assert done.count() == 60 and done.where("label < 0").count() == 0
    joined = done.join(reads.select("read_id", F.col("label").alias("truth")), "read_id")
    before = start.join(reads.select("read_id", F.col("label").alias("truth")), "read_id")
    score = lambda df: metrics.purity(metrics.contingency(df, "label", "truth")).first()[0]
    assert score(before) == 0.9 and score(joined) > 0.95
    summary = spark.read.parquet(f"{root}/round=1/summary").first()
    assert summary["round"] == 1 and summary["total_reads"] == 60 and 0 < summary["zone1_safe"] < 60 and summary["final_clusters"] >= 3
    assert sinks.last_round(spark, root) in (1, 2)
    again = rounds.iterate(reads.select("read_id", "seq"), start, root, 2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, done.collect()))


def test_kmers_and_differences(spark):
    assert kmers(2)[:5] == ["AA", "AC", "AG", "AT", "CA"]
    got = spark.range(1).select(kmer_embedding(F.lit("AAA")).alias("e"), kmer_embedding(F.lit("A")).alias("z")).first()
    assert got["e"][0] == 1.0 and sum(got["z"]) == 0
    rows = spark.createDataFrame([("ACGT", "AGGT"), ("AC", "ACG"), ("ACG", "AC"), (None, "A")], "a string, b string")
    assert [r[0] for r in rows.select(batches.difference("a", "b")).collect()] == ["A(C->G)GT", "AC[G]", "AC(-G)", None]
