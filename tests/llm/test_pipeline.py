"""The pipeline's stages on the smallest tables, each held against its input."""

import corpus_pipeline
from readlake.llm import decontaminate, near_dedup, quality_classifier
from readlake.llm.registry import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


def test_names():
    assert [f"op{n}_" for n in range(1, 11)] == [f"op{n}_" for n in range(1, 11) if sum(q.startswith(f"op{n}_") for q in QUERIES) == 1]
    assert set(ORACLES) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, bench = docs.columns, spark.read.parquet(f"{D}/benchmark.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, D).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append((before, docs))
    assert all(after.columns == columns for _, after in seen[:4])
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    good, lines, near, clean, mixed = (after for _, after in seen)
    model = quality_classifier.learn(seen[0][0], spark.read.parquet(f"{D}/labels.parquet"))
    assert ids(good) == ids(quality_classifier.score(seen[0][0], model).where("quality_score >= 0.3"))
    assert ids(lines) == ids(good) and all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    assert ids(near) == ids(near_dedup.near_duplicates(lines, 80, 10).where("kept"))
    assert ids(clean) == ids(decontaminate.flag(near, bench).where("NOT contaminated"))
    assert ids(mixed) == ids(clean)
    assert sorted(map(str, corpus_pipeline.run(spark, D).collect())) == sorted(map(str, mixed.collect()))
