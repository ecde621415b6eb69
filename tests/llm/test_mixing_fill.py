"""Operator 4 where one long document stands in the way of those that fit."""

from pyspark.sql import functions as F

from readlake.llm import mixing
from test_operators import prose, table


def test_a_document_that_holds_half_of_a_source(spark):
    # source a: one text of 1,000 words and 100 of 10; it is to give a third of 3,000 words, and 2,000 come from the other
    for shift in range(4):  # the long text at other places of the permutation
        texts = [prose(shift, 1000)] + [prose(i, 10) for i in range(100)] + [prose(i, 20) for i in range(50)]
        docs = table(spark, texts).withColumn("source", F.when(F.col("doc_id") < 101, "a").otherwise("b")).withColumn("doc_id", F.col("doc_id") + 1000 * shift)
        rows = mixing.mix(docs, weights=(1, 2), shards=8).collect()
        for name, smallest in (("a", 10), ("b", 20)):
            own = [r for r in rows if r["source"] == name]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < smallest, (shift, name)
        assert all(0 <= d["shard"] < 8 for r in rows for d in r["draws"])


def test_rows_that_repeat_a_doc_id_fit_together(spark):
    docs = table(spark, [prose(i, 10 + i % 7) for i in range(120)]).withColumn("source", F.when(F.col("doc_id") < 80, "a").otherwise("b"))
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id % 11 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    rows = mixing.mix(docs, weights=(1, 3), shards=8).collect()
    times = {}
    for r in rows:
        times.setdefault((r["source"], r["doc_id"]), set()).add(len(r["draws"]))
    assert all(len(x) == 1 for x in times.values()) and len(rows) == docs.count()
    for name in "ab":
        own = [r for r in rows if r["source"] == name]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 32
