"""Rows that repeat a doc_id, null doc_ids, very long texts, ties, odd labels and clashing columns, operator by operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake.llm import common, language_id, mixing, pii, quality_rules, substring_dedup, toxicity
from test_operators import TEXTS, labelled, pii_brute, prose, rules_brute, table, words

D = "/root/testdata/sf0.1"


def repeated(spark, texts=TEXTS):
    docs = table(spark, texts)
    return docs.unionByName(docs.where("doc_id < 8")).unionByName(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))


def test_substrings_of_repeated_and_null_ids(spark):
    rows = substring_dedup.remove_repeats(repeated(spark)).collect()
    assert len(rows) == len(TEXTS) + 9
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert all(len(by[i]) == 2 and by[i][0] == by[i][1] for i in range(8))
    assert by[None][0][1] == 0 and by[0][0] == (200, 0) and by[6][0][1] == by[6][0][0]


def test_rules_of_repeated_and_null_ids(spark):
    docs = repeated(spark)
    rows = quality_rules.apply_rules(docs, quality_rules.rank_rules(docs)).collect()
    assert len(rows) == len(TEXTS) + 9
    for r in rows:
        assert tuple(r[k] for k in quality_rules.BASE) == rules_brute(TEXTS[6 if r["doc_id"] is None else r["doc_id"]])


def test_mixing_of_repeated_ids_ties_and_a_very_long_text(spark):
    texts = [prose(1, 30000)] + [prose(i, 20) for i in range(80)] + [None, "\n"]
    docs = repeated(spark, texts)
    rows = mixing.mix(docs, shards=4).collect()
    assert len(rows) == len(texts) + 9 and sum(r["size"] for r in rows) == sum(len(words(t)) for t in texts) + sum(len(words(t)) for t in texts[:8]) + 20
    by = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        by.setdefault(r["doc_id"], set()).add(r["taken"])
    assert all(len(x) == 1 for x in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, shards=4).collect()))


def test_private_data_of_repeated_ids_and_a_very_long_text(spark):
    long = prose(3, 40000) + " mail a.b@c.de token = AB12-CD34-99 " + prose(4, 40000)
    docs = repeated(spark, [long, "x 1.2.3.4 y", None, "", "a@b.cc", "t", "4111 1111 1111 1111", "z"])
    rows = pii.find_private(docs).collect()
    assert len(rows) == 17
    for r in rows:
        text = docs.where(F.col("doc_id").eqNullSafe(F.lit(r["doc_id"]).cast("long"))).first()["text"] or ""
        assert [tuple(x) for x in r["base"]] == pii_brute(text)


def test_language_of_tied_sizes_repeated_ids_and_clashing_columns(spark):
    rows = [(i, "the same words in each", "bb" if i % 2 else "aa") for i in range(60)] + [(None, "the same words", "aa"), (1, "the same", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit(1), "score": F.lit("s"), "rejected": F.lit(2)})
    got = language_id.identify(docs, language_id.learn(docs)).collect()
    assert len(got) == 62 and {r["lang_pred"] for r in got} == {"aa"} and all(r["rejected"] for r in got)


def test_toxicity_of_odd_labels_repeated_ids_and_few_positives(spark):
    docs, labels, truth = labelled(spark)
    docs = docs.withColumns({"label": F.lit(3), "toxic_score": F.lit("x")}).unionByName(docs.limit(0), allowMissingColumns=True)
    twice = docs.unionByName(docs.where("doc_id < 30")).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    more = spark.createDataFrame([(None, 1, 1), (3, None, None), (5, 7, 7), (2, 1, 1), (2, 1, 0)], labels.schema)
    got = toxicity.score(twice, toxicity.learn(twice, labels.unionByName(more))).collect()
    assert len(got) == 403 + 31
    right = [(r["toxic_score"] >= 0.5) == (truth[r["doc_id"]][2] == 1) for r in got if r["doc_id"] is not None and r["doc_id"] < 400]
    assert np.mean(right) > 0.97


@pytest.mark.parametrize("what", ["language", "toxicity"])
def test_held_out_figures(spark, what):
    docs = common.table(spark, D, "documents")
    held = docs.where(common.in_fold("doc_id"))
    if what == "language":
        got = language_id.identify(held, language_id.learn(docs)).join(held.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred != 'und'")
        assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
    else:
        labels = common.table(spark, D, "labels")
        got = toxicity.score(held, toxicity.learn(docs.select("doc_id", "text"), labels)).join(labels, "doc_id").select("toxic", (F.col("toxic_score") >= 0.5).alias("hit")).collect()
        rate = lambda k: np.mean([r["hit"] for r in got if r["toxic"] == k])
        assert rate(1) >= 0.85 and rate(0) <= 0.03
