"""The index of best matches has what may be asked for, and no more."""

from readlake.operators import match


def test_index_is_bounded_by_what_is_asked(spark):
    rows = spark.createDataFrame([(1, "ACGTTGCAAGTC" * 3)], "id long, seq string")
    others = spark.createDataFrame([(2, "ACGTTGCAAGTC" * 3), (3, "ACGTTGCAAGTC" * 20), (4, "A" * 36), (5, "ACGTTGCAAGTC" + "A" * 14), (6, None)], "id long, seq string")
    like = match._like_lengths(others, rows, 10)
    assert sorted(r["id"] for r in like.collect()) == [2, 4, 5]
    index = match._asked(match._index(like, 12, True), rows, 12)
    assert sorted((r["other_id"], r["at"]) for r in index.collect()) == [(2, 0), (2, 12), (2, 24), (5, 0)]


def test_texts_are_read_once(spark, monkeypatch):
    from readlake.plans import catalogue

    plan = catalogue.best_match_edit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan
