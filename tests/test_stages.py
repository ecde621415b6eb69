"""Stages are run when something that they depend on has changed, and only then."""

import json

import pytest
from pyspark.sql import functions as F

from readlake.plans import rounds, stages


def chain(spark, root, left, right, factor=2):
    """Two sources, a stage on each, and one on both."""
    store = stages.Store(spark, root)
    a, b = store.source(left), store.source(right)
    x = store.stage("x", lambda rows: {"out": rows.withColumn("v", F.col("v") * factor)}, {"rows": a}, {"factor": factor})
    y = store.stage("y", lambda rows: {"out": rows.distinct(), "sizes": rows.agg(F.count("*").alias("n"))}, {"rows": b})
    both = store.stage("both", lambda one, two: {"out": one.join(two, "k")}, {"one": x["out"], "two": y["out"]})
    return store.ran, sorted(map(tuple, both["out"].df.select("k", "v", "w").collect()))


def test_only_what_depends_on_a_change_is_run(spark, tmp_path):
    left = spark.createDataFrame([(i, i * 10) for i in range(6)], "k long, v long")
    right = spark.createDataFrame([(i, f"w{i}") for i in range(6)] * 2, "k long, w string")
    root = str(tmp_path / "s")
    ran, rows = chain(spark, root, left, right)
    assert ran == ["x", "y", "both"] and rows == [(i, i * 20, f"w{i}") for i in range(6)]
    assert chain(spark, root, left.orderBy(F.desc("k")), right.repartition(3)) == ([], rows)  # the order of rows says nothing
    ran, more = chain(spark, root, left.where("k < 3"), right)
    assert ran == ["x", "both"] and more == rows[:3]
    ran, more = chain(spark, root, left.where("k < 3"), right, factor=5)
    assert ran == ["x", "both"] and more == [(i, i * 50, f"w{i}") for i in range(3)]
    ran, _ = chain(spark, root, left.where("k < 3"), right.unionByName(right.limit(1)), factor=5)
    assert ran == ["y", "both"]


def test_a_run_cut_short_is_no_finished_one(spark, tmp_path):
    store = stages.Store(spark, str(tmp_path / "s"))
    src = store.source(spark.range(4))
    good = lambda rows: {"out": rows}
    store.stage("x", good, {"rows": src})

    def broken(tables):
        tables["out"].write.mode("overwrite").parquet(str(tmp_path / "s" / "x" / "out"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.stage("x", good, {"rows": src}, {"new": 1}, broken)
    assert store.manifest("x") is None and not (tmp_path / "s" / "x" / "_manifest.json").exists()
    assert store.stage("x", good, {"rows": src})["out"].df.count() == 4 and store.ran == ["x", "x"]
    kept = json.loads((tmp_path / "s" / "x" / "_manifest.json").read_text())
    assert kept["tables"] == ["out"] and set(kept["inputs"]) == {"rows"}


def test_fingerprints_are_of_rows(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, None)], "k int, `odd name` string, e array<double>")
    same = stages.rows_fingerprint(df)
    assert stages.rows_fingerprint(df.orderBy(F.desc("k")).select("e", "odd name", "k")) == same
    assert len({same, *(stages.rows_fingerprint(x) for x in (df.limit(1), df.unionByName(df), df.withColumn("k", F.col("k").cast("long")), df.where("false")))}) == 5


def test_rounds_follow_changed_reads_and_keep_logs(spark, tmp_path):
    rows = [(i, "ACGTACGTAC"[i % 3 :] + "GGTTACGA" * (1 + i % 2), i % 2 + 1) for i in range(24)]
    reads = spark.createDataFrame(rows, "read_id long, seq string, label int")
    root = str(tmp_path / "r")
    run = lambda df: rounds.iterate(df.select("read_id", "seq"), df.select("read_id", "label"), root, 2, settled=0.0)
    first = sorted(map(tuple, run(reads).collect()))
    stamp = lambda: [(tmp_path / "r" / f"round={k}" / "_manifest.json").stat().st_mtime_ns for k in (1, 2)]
    before = stamp()
    assert sorted(map(tuple, run(reads).collect())) == first and stamp() == before
    assert len(run(reads.where("read_id < 20")).collect()) == 20 and all(a != b for a, b in zip(stamp(), before))
    log, changes = (spark.read.csv(f"{root}/{n}", header=True, inferSchema=True).collect() for n in ("log", "convergence"))
    assert [r["round"] for r in log] == [r["round"] for r in changes] == [1, 2] and all(r["total_reads"] == 20 for r in log)
    assert all(0 <= r["label_change_rate"] <= 1 for r in changes)
