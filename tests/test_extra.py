"""Operators against plain Python on small inputs, and the queries of plans/extra.py against their SQL."""

import itertools
import math
import random
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import ROOT
from readlake.operators import batches, cluster, decode, match, metrics, refine, scorer, voting
from readlake.plans import extra
from readlake.sources import simulate, sinks, text

D = "/root/testdata/sf0.001"
NAMES = [k for k, f in entry.queries().items() if f.__module__ == extra.__name__] + ["batch_packing", "batch_stats", "hash_sample"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "part", "customer", "events", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = entry.queries()[name](spark, D)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


def test_entry_imports_without_a_session():
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=ROOT).returncode == 0


def sizes_packed(sizes, size, most):
    """Next fit, in order: list of batches, each a list of (cluster, begin, taken)."""
    out, room = [], 0
    for c, n in sizes:
        if n < 2:
            continue
        if n > size:
            out += [[(c, b, min(size, n - b))] for b in range(0, n, size)]
            room = 0
        elif n <= room and len(out[-1]) < most:
            out[-1].append((c, 0, n))
            room -= n
        else:
            out.append([(c, 0, n)])
            room = size - n
    single = [(c, 0, n) for c, n in sizes if n < 2]
    return out + [single[i : i + size] for i in range(0, len(single), size)]


@pytest.mark.parametrize("size,most", [(8, 64), (16, 2), (5, 3)])
def test_batches(spark, size, most):
    rng = random.Random(size)
    sizes = [(f"c{i:03d}", rng.choice([1, 1, 2, 3, 4, 7, 9, 30])) for i in range(120)]
    got = batches.pack(spark.createDataFrame(sizes, "cid string, n long"), size, most_clusters=most).collect()
    want = {(c, b, t, k) for k, batch in enumerate(sizes_packed(sizes, size, most)) for c, b, t in batch}
    assert {(r["cid"], r["begin"], r["taken"], r["batch_id"]) for r in got} == want and len(got) == len(want)
    lanes = batches.pack(spark.createDataFrame(sizes, "cid string, n long"), size, most_clusters=most, lanes=3)
    assert lanes.agg(F.sum("taken")).first()[0] == sum(n for _, n in sizes) and lanes.select("lane").distinct().count() == 3
    assert batches.pack(spark.createDataFrame([], "cid string, n long"), 4).count() == 0


def test_exact_percentile_narrows_to_the_same_value(spark):
    rng = random.Random(3)
    for values in ([rng.random() for _ in range(5000)], [1.0] * 3000 + [rng.random() for _ in range(500)], [float(i // 900) for i in range(4000)], [2.5], [None, 1.0, 2.0]):
        rows = spark.createDataFrame([(x,) for x in values], "x double")
        for share in (0.0, 0.25, 0.5, 0.9, 0.95, 1.0):
            want = rows.agg(F.percentile("x", F.lit(share))).first()[0]
            assert refine.exact_percentile(rows, "x", share, 200) == pytest.approx(want, abs=1e-12)
    assert refine.exact_percentile(spark.createDataFrame([], "x double"), "x", 0.5) is None


@pytest.mark.parametrize("most,depth,parts", [(2, 15, 5), (1, 15, 3), (3, 15, 5), (2, 18, 4)])
def test_anchor_pairs(spark, most, depth, parts):
    rng = random.Random(most)
    seqs = ["".join(rng.choice("ACGTNR" if i % 9 == 0 else "ACGT") for _ in range(20)) for i in range(60)]
    for k in range(140):
        s = list(seqs[k % 60])
        for _ in range(rng.randrange(4)):
            s[rng.randrange(18)] = rng.choice("ACGT")
        seqs.append("".join(s))
    seqs.append("ACGT")
    rows = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    least = {}
    for i, s in enumerate(seqs):
        if len(s) >= depth:
            least.setdefault(s[:depth], i)
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    want = {(*sorted((least[a], least[b])), far(a, b)) for a, b in itertools.combinations(least, 2) if far(a, b) <= most}
    want |= {(least[s[:depth]], i, 0) for i, s in enumerate(seqs) if len(s) >= depth and least[s[:depth]] != i}
    got = [tuple(r) for r in match.anchor_pairs(rows, most, depth, parts).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_best_matches_either_way(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pred = spark.createDataFrame([(i, word(rng.randrange(30, 60))) for i in range(60)], "pred_id long, pred_seq string")
    truth = spark.createDataFrame([(i, word(rng.randrange(30, 60))) for i in range(40)], "gt_id long, gt_seq string")
    few = sorted(map(tuple, match.near_lengths(pred, truth, 5).select("pred_id", "gt_id").collect()))
    monkeypatch.setattr(match, "BROADCAST_ROWS", 3)
    many = sorted(map(tuple, match.near_lengths(pred, truth, 5).select("pred_id", "gt_id").collect()))
    p, t = dict(map(tuple, pred.collect())), dict(map(tuple, truth.collect()))
    assert few == many == sorted((i, j) for i in p for j in t if abs(len(p[i]) - len(t[j])) <= 5)


def test_scores_tell_the_reads_of_a_cluster_apart(spark):
    reads = spark.createDataFrame([(i, 1, "ACGT" * 10 if i else "TGCA" * 10) for i in range(8)] + [(8, 1, ""), (9, 1, "NNNN")], "read_id long, label int, seq string")
    got = {r["read_id"]: r for r in scorer.default_scorer(reads).collect()}
    assert len(got) == 10 and got[0]["u_ale"] > got[1]["u_ale"] == got[7]["u_ale"] and got[9]["u_ale"] > got[1]["u_ale"]


def test_counts_fuse_as_evidence_does(spark):
    refs = simulate.references(spark, 5, 40)
    reads = simulate.substitution_channel(refs, 9, 0.05, 0.2).selectExpr("read_id", "label", "seq", "1.0D + read_id % 3 AS strength", "read_id % 4 = 0 AS high_conf")
    assert sorted(map(tuple, decode.consensus(reads).collect())) == sorted(map(tuple, decode.consensus(reads, decode.pseudo_counts(reads)).collect()))


def put(tmp_path, name, body):
    (tmp_path / name).write_text(body)
    return str(tmp_path / name)


def test_blank_lines_and_quality_lines(spark, tmp_path):
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(text.read_references(spark, put(tmp_path, "a", "\n\nt1\n\nACGT\nt2\n  \nTT\n"))) == [("t1", "ACGT"), ("t2", "TT")]
    assert rows(text.read_references(spark, put(tmp_path, "b", "\n>t1\n\nAC\nGT\n"))) == [("t1", "ACGT")]
    assert rows(text.read_ids(spark, put(tmp_path, "c", "@r1 x\nAC\n+\n@I\n@r2\nGT\n+\n>>\n"))) == [("r1",), ("r2",)]
    assert rows(text.read_ids(spark, put(tmp_path, "d", "# note\nr1 AC\n>r2 more\nAC\nbare\n"))) == [("r1",), ("r2",)]
    assert rows(text.read_bulk(spark, put(tmp_path, "e", "1 AC\nN2 AC\n3 AN\n4 A*\nx\n"), star=True)) == [(1, "1", "AC")]
    assert [r["num_reads"] for r in text.read_consensus(spark, put(tmp_path, "f", ">cluster_3\nAC\n")).collect()] == [1]
    assert text.read_references(spark, put(tmp_path, "g", "\n")).count() == 0


def test_records_of_a_file_in_many_blocks(spark, tmp_path):
    body = "".join(f">r{i}\n{'ACGT' * (i % 7)}\n{'TT' * (i % 3)}\n\n" for i in range(3000))
    path = put(tmp_path, "big.fasta", body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert text.lines(spark, path).rdd.getNumPartitions() >= 1
        got = dict(map(tuple, text.read_fasta(spark, path).collect()))
        blocks = put(tmp_path, "big.txt", "".join(f"R{i}\nA{i}\n\n=====\n" for i in range(2000)))
        pairs = {(r["block_id"], r["seq"], r["is_ref"]) for r in text.read_blocks(spark, blocks).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"r{i}": "ACGT" * (i % 7) + "TT" * (i % 3) for i in range(3000)}
    assert pairs == {(i, f"R{i}", True) for i in range(2000)} | {(i, f"A{i}", False) for i in range(2000)}


def test_labels_history_cores_and_reports(spark, tmp_path):
    old = spark.createDataFrame([(0, 1), (1, 2)], "read_id long, label int")
    label = lambda new: sorted(map(tuple, voting.kept_labels(old, spark.createDataFrame(new, "read_id long, label int")).collect()))
    assert label([(0, 5)]) == [(0, 1), (1, 2)] and label([(0, 5), (1, -1)]) == [(0, 5), (1, -1)]
    rows = spark.createDataFrame([(["1", "NaN", None, "x", "-Infinity"],), ([],), (None,)], "h array<string>").select(metrics.finite_history(F.col("h")).alias("h"))
    assert [r["h"] for r in rows.collect()] == [[1.0, 0.0, 0.0, 0.0, 0.0], [0.0], [0.0]]
    members = [("x", "AAAA", "AATA")] * 6 + [("x", "AAAA", "CAAA")] * 2 + [("y", "AAAA", "AATA")] * 5 + [("z", "AAAA", "AAAA")]
    got = dict(map(tuple, cluster.corrected_cores(spark.createDataFrame(members, "cluster_id string, core string, anchor string")).collect()))
    assert got == {"x": "AATA", "y": "AAAA", "z": "AAAA"}
    sinks.write_report(spark.createDataFrame([(1, 0.5)], "a int, b double"), str(tmp_path / "report"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a: 1", "b: 0.5"]
    sinks.write_log(spark.createDataFrame([(1, 0.5)], "a int, b double"), str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).first().asDict() == {"a": "1", "b": "0.5"}
    sinks.write_metadata(spark.createDataFrame([("2", "1"), ("1", "1")], "read_id string, cluster_id string"), str(tmp_path / "meta"))
    assert spark.read.csv(str(tmp_path / "meta"), header=True).count() == 2
    sinks.write_metrics(spark.createDataFrame([(1, math.pi)], "a int, b double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["b"] == math.pi
