"""The pipeline's near dedup against brute force at its own bound of similarity."""

import corpus_pipeline
from readlake.llm import decontaminate, near_dedup
from test_operators import near_brute, near_texts, prose, table

D = "/root/testdata/sf0.001"


def between():
    """Texts of 100 shingles, each with copies that have 5, 10 and 15 of them changed: 0.90, 0.82 and 0.74 similar."""
    out = []
    for k in range(8):
        w = prose(200 + k, 104).split()
        out.append(" ".join(w))
        for edits in (1, 2, 3):
            copy = list(w)
            copy[20 : 20 + 20 * edits : 20] = [f"z{k}" for _ in range(edits)]
            out.append(" ".join(copy))
    return out


def test_near_copies_from_80_percent_on_go(spark):
    texts = near_texts() + between()
    docs = table(spark, texts)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    want = {i for i, (_, _, first) in near_brute(texts, 80).items() if first}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    assert want < {i for i, (_, _, first) in near_brute(texts, 85).items() if first}


def test_stages_after_near_dedup(spark):
    """The stages of test_pipeline.py from near dedup on, at the stage's own bound."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    near = corpus_pipeline.drop_near_copies(spark, docs, D).cache()
    assert ids(near) == ids(near_dedup.near_duplicates(docs, 80, 10).where("kept"))
    clean = corpus_pipeline.drop_benchmark(spark, near, D).cache()
    assert ids(clean) == ids(decontaminate.flag(near, spark.read.parquet(f"{D}/benchmark.parquet")).where("NOT contaminated"))
    assert ids(corpus_pipeline.mix_sources(spark, clean, D)) == ids(clean)
