from readlake.operators import decode
from readlake.sources import simulate, sinks, text


def put(tmp_path, name, body):
    (tmp_path / name).write_text(body)
    return str(tmp_path / name)


def test_indexed_and_tagged(spark, tmp_path):
    p = put(tmp_path, "r.txt", "1 AAAA\nbad\n2 CCCC\n1 GGGG\n")
    assert {tuple(r) for r in text.read_indexed(spark, p).collect()} == {("1", "GGGG"), ("2", "CCCC")}
    assert [tuple(r) for r in text.read_tagged(spark, p).orderBy("line_no").collect()] == [(1, "1", "AAAA"), (3, "2", "CCCC"), (4, "1", "GGGG")]


def test_fasta_fastq(spark, tmp_path):
    p = put(tmp_path, "a.fasta", ">x 1\nAC\nGT\n>y\nTT\n")
    assert {tuple(r) for r in text.read_fasta(spark, p).collect()} == {("x 1", "ACGT"), ("y", "TT")}
    assert {tuple(r) for r in text.read_fasta(spark, p, last_line_only=True).collect()} == {("x 1", "GT"), ("y", "TT")}
    q = put(tmp_path, "a.fastq", "@r1\nAC\n+\nII\n@r2\nGT\n+\nII\n")
    assert {tuple(r) for r in text.read_fastq(spark, q).collect()} == {("r1", "AC"), ("r2", "GT")}
    assert {r[0] for r in text.read_ids(spark, p).collect()} == {"x", "y"}


def test_references_either_form(spark, tmp_path):
    assert {tuple(r) for r in text.read_references(spark, put(tmp_path, "f", ">t1\nAC\nGT\n")).collect()} == {("t1", "ACGT")}
    assert {tuple(r) for r in text.read_references(spark, put(tmp_path, "g", "t1\nACGT\nt2\nTT\n")).collect()} == {("t1", "ACGT"), ("t2", "TT")}


def test_blocks_labels_assignments(spark, tmp_path):
    p = put(tmp_path, "b.txt", "REF\nA\nB\n======\nREF2\nC\n======\n")
    got = [tuple(r) for r in text.read_blocks(spark, p).orderBy("block_id", "pos").collect()]
    assert got == [(0, 0, "REF", True), (0, 1, "A", False), (0, 2, "B", False), (1, 0, "REF2", True), (1, 1, "C", False)]
    assert [tuple(r) for r in text.read_labels(spark, put(tmp_path, "l", "3\n-1\n0\n")).orderBy("read_id").collect()] == [(0, 3), (1, -1), (2, 0)]
    a = put(tmp_path, "a.txt", "[('6', '1'), ('5', '2')][('4', '3')]\n")
    assert {tuple(r) for r in text.read_assignments(spark, a).collect()} == {("6", "1"), ("5", "2"), ("4", "3")}


def test_centers_and_training(spark, tmp_path):
    p = put(tmp_path, "c.txt", "A" * 25 + "\nshort\n" + "C" * 30 + "\n")
    assert {tuple(r) for r in text.read_centers(spark, p).collect()} == {(0, "A" * 25), (2, "C" * 30)}
    (tmp_path / "D/I/train").mkdir(parents=True)
    put(tmp_path / "D/I/train", "reads.txt", "A\nB\n====\n====\nC\n====\n")
    put(tmp_path / "D/I/train", "reference.txt", "R0\nR1\nR2\n")
    got = {(r["block_id"], tuple(r["reads"]), r["reference"]) for r in text.read_training(spark, str(tmp_path / "D"), "I", "train").collect()}
    assert got == {(0, ("A", "B"), "R0"), (2, ("C",), "R2")}


def test_round_trips(spark, tmp_path):
    pairs = spark.createDataFrame([("6", "1"), ("5", "2"), ("4", "1")], "read_id string, cluster_id string")
    sinks.write_assignments(pairs, str(tmp_path / "pairs"))
    assert {tuple(r) for r in text.read_assignments(spark, str(tmp_path / "pairs/*.txt")).collect()} == {("6", "1"), ("5", "2"), ("4", "1")}
    records = spark.createDataFrame([(1, 5, 2, 1.5, "ACGT"), (2, 3, 1, 0.25, "TTTT")], "cluster_id int, num_reads int, num_high_conf int, avg_strength double, seq string")
    sinks.write_consensus(records, str(tmp_path / "cons"))
    assert sorted(map(tuple, text.read_consensus(spark, str(tmp_path / "cons/*.txt")).collect())) == sorted(map(tuple, records.collect()))
    blocks = spark.createDataFrame([(1, "RR", ["A", "B"])], "cid int, reference string, reads array<string>")
    sinks.write_blocks(blocks, str(tmp_path / "blocks"))
    assert [r["seq"] for r in text.read_blocks(spark, str(tmp_path / "blocks/*.txt")).orderBy("pos").collect()] == ["RR", "A", "B"]
    assert sinks.last_round(spark, str(tmp_path / "rounds")) == 0
    sinks.write_round({"labels": pairs}, str(tmp_path / "rounds"), 3)
    assert sinks.last_round(spark, str(tmp_path / "rounds")) == 3


def test_simulated_reads_decode_to_their_references(spark):
    refs = simulate.references(spark, 4, 60)
    reads = simulate.substitution_channel(refs, 12, 0.01, 0.03).selectExpr("read_id", "label", "seq", "1.0D AS strength", "true AS high_conf")
    assert reads.count() == 48 and reads.exceptAll(simulate.substitution_channel(refs, 12, 0.01, 0.03).selectExpr("read_id", "label", "seq", "1.0D AS strength", "true AS high_conf")).isEmpty()
    got = {r["cluster_id"]: r["seq"] for r in decode.consensus(reads, decode.pseudo_counts(reads)).collect()}
    assert got == {r["Cluster_ID"]: r["Ref_Seq"] for r in refs.collect()}
    assert simulate.ids_channel(refs, 10).count() > 20


def test_windowed_stream(spark):
    from pyspark.sql import functions as F

    from readlake.streaming import votes

    rows = spark.readStream.format("rate").option("rowsPerSecond", 5).load().select(F.col("timestamp").alias("ts"), F.lit("a").alias("event_type"))
    assert votes.windowed_counts(rows).isStreaming
