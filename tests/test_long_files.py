"""Blocks, labels and lists over the ends of files and of byte ranges."""

import random

import pytest
from pyspark.sql import functions as F

from readlake.operators import voting
from readlake.sources import sinks, text


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plain_blocks(content):
    """By one pass over all lines."""
    out, block, pos = [], 0, 0
    for line in content.split("\n"):
        if line.startswith("===="):
            block, pos = block + 1, 0
        elif line.strip():
            out.append((block, pos, line.strip(), pos == 0))
            pos += 1
    return out


def test_blocks_go_on_over_files_and_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    lines = []
    for k in range(60):
        lines += [f"ref{k}"] + [f"read{k}_{i}" if rng.random() < 0.9 else "" for i in range(rng.choice([0, 1, 3, 90]))] + ["=" * 32]
    lines += ["last", "open"]
    lines[5:5] = ["=" * 32, "=" * 32]  # blocks without lines
    cuts = sorted(rng.sample(range(len(lines)), 5))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(lines)])):
        (tmp_path / f"part-{k:05d}.txt").write_text("".join(x + "\n" for x in lines[a:b]))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 12
    got = sorted(map(tuple, text.read_blocks(spark, str(tmp_path)).select("block_id", "pos", "seq", "is_ref").collect()))
    assert got == sorted(plain_blocks("\n".join(lines)))


def test_one_line_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    """Pairs across the ends of ranges are neither lost nor doubled; spaces and line ends between them, noise, and several lists make no difference."""
    pairs = [(f"read_{i}", f"c{i % 7}") for i in range(500)]
    body = "[" + ", ".join(f"('{a}', '{b}')" for a, b in pairs[:300]) + "][" + ",\n ".join(f"({a},'{b}')" for a, b in pairs[300:]) + ", ('x', '-1')]\n"
    (tmp_path / "list.txt").write_text(body)
    df = text.read_assignment_list(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, df.collect())) == sorted(pairs)
    assert text.read_assignment_list(spark, str(tmp_path), drop_noise=False).count() == 501


def test_large_list_on_one_line(spark, tmp_path):
    """64 MB on one line, under a setting that gives ranges of 8 MB."""
    n = 2_200_000
    sinks.write_assignment_list(spark.range(n).coalesce(1).select(F.format_string("read_%012d", "id").alias("read_id"), F.format_string("c%d", F.col("id") % 1000).alias("cluster_id")), str(tmp_path / "w"))
    (path,) = (tmp_path / "w").glob("part-*")
    assert path.stat().st_size > 64 << 20 and b"\n" not in path.read_bytes()[:1000]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        df = text.read_assignment_list(spark, str(path))
        assert df.rdd.getNumPartitions() >= 7
        assert tuple(df.agg(F.count("*"), F.count_distinct("read_id"), F.count_distinct("cluster_id")).first()) == (n, n, 1000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_label_lines(spark, tmp_path, small_ranges):
    labels = {0: 4, 3: 1, 900: 2, 901: -1}
    sinks.write_label_lines(spark.createDataFrame([*labels.items(), (3, 7)], "read_id long, label int"), str(tmp_path / "w"), 1000)
    got = {r["read_id"]: r["label"] for r in text.read_labels(spark, str(tmp_path / "w")).collect()}
    assert got == {i: labels.get(i, -1) for i in range(1000)}
    lines = [x for p in sorted((tmp_path / "w").glob("part-*")) for x in p.read_text().split()]
    assert lines == [str(labels.get(i, -1)) for i in range(1000)]
    with pytest.raises(ValueError, match="no place"):
        sinks.write_label_lines(spark.createDataFrame([(7, 1)], "read_id long, label int"), str(tmp_path / "x"), 5)
    # labels of another length leave the old ones
    old = spark.range(900).select(F.col("id").alias("read_id"), F.lit(9).alias("label"))
    assert voting.kept_labels(old, text.read_labels(spark, str(tmp_path / "w"))).where("label <> 9").count() == 0
    old = spark.range(1000).select(F.col("id").alias("read_id"), F.lit(9).alias("label"))
    assert {r["read_id"]: r["label"] for r in voting.kept_labels(old, text.read_labels(spark, str(tmp_path / "w"))).collect()} == got
