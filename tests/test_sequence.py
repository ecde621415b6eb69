from pyspark.sql import functions as F

from readlake.functions import sequence as s
from readlake.functions import vector as v
from readlake.operators import match, metrics, refine, voting
from readlake.operators.cluster import AnchorIndex, ClusterConfig, OnlineClusters, online


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_mismatches(spark):
    assert [(r["pos"], r["base"]) for r in one(spark, s.mismatches(F.lit("AAA"), F.lit("ATA")))] == [(1, "T")]
    assert one(spark, s.mismatches(F.lit(""), F.lit(""))) == []


def test_identity_is_symmetric_and_bounded(spark):
    rows = spark.createDataFrame([("ACGT", "ACGA"), ("ACGT", "AC"), ("", "A"), ("A", "A")], "a string, b string")
    got = rows.select(s.identity(F.col("a"), F.col("b")).alias("x"), s.identity(F.col("b"), F.col("a")).alias("y")).collect()
    assert [r["x"] for r in got] == [0.75, 0.5, 0.0, 1.0] and all(r["x"] == r["y"] for r in got)


def test_trims(spark):
    assert one(spark, s.payload(F.lit("GGTCAACGT"), "TCA", 3)) == "ACG"
    assert one(spark, s.payload(F.lit("GGG"), "TCA", 5, pad=True)) == "GGGNN"
    assert one(spark, s.trimmed_reference(F.lit("A" * 25 + "C" * 10 + "T" * 25))) == "C" * 10
    assert one(spark, s.from_indices(s.one_hot(F.lit("ACNT")))) == "ACAT"


def test_pairs_and_headers(spark):
    got = one(spark, s.pairs_in(F.lit("[('6', '1'), ('5', '2')][(4,3)]")))
    assert [(r["follower"], r["founder"]) for r in got] == [("6", "1"), ("5", "2"), ("4", "3")]
    row = spark.range(1).select(*(x.alias(k) for k, x in s.header_fields(F.lit(">cluster_7_reads12_highconf3_strength1.250")).items())).first()
    assert tuple(row) == (7, 12, 3, 1.25)


def test_digamma_and_lgamma(spark):
    assert abs(one(spark, v.digamma(F.lit(1.0))) + 0.5772156649015329) < 1e-9
    assert abs(one(spark, v.lgamma(F.lit(5.0))) - 3.1780538303479458) < 1e-9
    assert abs(one(spark, v.dirichlet_kl(F.array(*[F.lit(1.0)] * 4)))) < 1e-9


def test_anchor_index():
    index = AnchorIndex(3)
    index.insert("AA", 1)
    assert index.get("AA") == 1
    index.delete("AA")
    assert index.get("AA") is None and index.nearest("AA") == (None, 3)
    index.insert("AAAA", 2)
    assert index.nearest("ATAA") == (2, 1)


def test_online_clusters_two_equal_reads():
    state = OnlineClusters(ClusterConfig(length=6, depth=4, drift=0))
    assert state.place(1, "AAAAAA") == (1, "founder")
    assert state.place(2, "AAAAAA") == (1, "joined")


def test_online_matches_plain_python(spark):
    refs = ["ACGTACGTACGTACGTACGT" * 8, "TTGACCATGACTGACTAGCA" * 8]
    rows = [(i, r[:145] + "ACGTA"[: i % 5 + 1].ljust(5, "C")) for i, r in enumerate(refs * 4)]
    got = {r["read_id"]: (r["cluster_id"], r["status"]) for r in online(spark.createDataFrame(rows, "read_id long, seq string")).collect()}
    state = OnlineClusters(ClusterConfig())
    assert got == {i: state.place(i, seq) for i, seq in rows}


def test_blocked_join_is_complete(spark):
    import itertools
    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("ACGT") for _ in range(15)) for _ in range(6)]
    seqs = [b for b in base] + ["".join(rng.choice("ACGT") if rng.random() < 0.12 else x for x in rng.choice(base)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    got = {(r["left_id"], r["right_id"]) for r in match.anchor_pairs(rows).where("distance > 0").collect()}
    first = {}
    for i, q in enumerate(seqs):
        first.setdefault(q, i)
    want = {(min(first[a], first[b]), max(first[a], first[b])) for a, b in itertools.combinations(first, 2) if sum(x != y for x, y in zip(a, b)) <= 2}
    assert got == want


def test_votes_and_metadata(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 1), (1, "b", 2), (1, "a", 4), (2, "c", 9)], "cid int, tag string, pos int")
    assert {tuple(r) for r in voting.vote(rows).collect()} == {(1, "a", 2, 4), (2, "c", 1, 1)}
    assert {tuple(r) for r in voting.vote(rows, order="pos").collect()} == {(1, "b", 2, 4), (2, "c", 1, 1)}
    pairs = spark.createDataFrame([("6", "1"), ("5", "2"), ("4", "3")], "read_id string, cluster_id string")
    reads = spark.createDataFrame([(str(i),) for i in range(1, 8)], "read_id string")
    got = {r["read_id"]: r["cluster_id"] for r in voting.metadata(pairs, reads).collect()}
    assert got == {"1": "1", "2": "2", "3": "3", "4": "3", "5": "2", "6": "1", "7": "-1"}
    assert len(voting.join_assignments(reads, pairs).collect()) == 6
    assert len(voting.join_assignments(reads, pairs, include_founders=False).collect()) == 3


def test_dedup_is_idempotent(spark):
    rows = spark.createDataFrame([(1, 5, "AC"), (2, 9, "AC"), (3, 9, "AC"), (4, 1, "GT")], "cluster_id int, num_reads int, seq string")
    once = voting.keep_largest(rows)
    assert {r["cluster_id"] for r in once.collect()} == {2, 4}
    assert sorted(voting.keep_largest(once).collect()) == sorted(once.collect())


def test_metric_properties(spark):
    rows = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] + [("b", "y")] * 2 + [(None, "x")], "pred string, truth string")
    t = metrics.contingency(rows, "pred", "truth")
    assert metrics.purity(t).first()[0] == metrics.micro_accuracy(rows, "pred", "truth").first()[0] == 5 / 6
    same = metrics.contingency(rows.withColumn("truth", F.col("pred")), "pred", "truth")
    assert metrics.adjusted_rand(same).first()[0] == 1.0 and abs(metrics.normalised_information(same).first()[0] - 1) < 1e-12
    single = metrics.contingency(spark.createDataFrame([("a", "x")], "pred string, truth string"), "pred", "truth")
    assert metrics.adjusted_rand(single).first()[0] == 1.0 and metrics.normalised_information(single).first()[0] == 1.0


def scored(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(60):
        e = [rng.gauss(0, 1) + 3 * (d == i % 3) for d in range(4)]
        n = sum(x * x for x in e) ** 0.5
        rows.append((i, i % 3 if i % 10 else -1, [x / n for x in e], rng.random(), rng.random(), 1 + rng.random()))
    return spark.createDataFrame(rows, "read_id long, label int, embedding array<double>, u_epi double, u_ale double, strength double")


def test_refine_properties(spark):
    z = refine.zones(scored(spark)).cache()
    assert {r["zone"] for r in z.collect()} == {0, 1, 2, 3}
    cents = refine.centroids(z).cache()
    assert all(abs(sum(x * x for x in r["centroid"]) - 1) < 1e-9 for r in cents.collect())
    done = refine.refine(z, cents, refine.radius(z, cents)).collect()
    assert all(r["new_label"] == r["label"] for r in done if r["zone"] in (0, 1)) and all(r["new_label"] == -1 for r in done if r["zone"] == 3)
    a = {r["read_id"]: r["nearest"] for r in refine.nearest(z, cents).collect()}
    assert a == {r["read_id"]: r["nearest"] for r in refine.nearest_sql(z, cents).collect()}
    assert a == {r["read_id"]: r["nearest"] for r in refine.nearest(z, cents, broadcast_rows=1).collect()}
    assert all(r["label"] >= 0 for r in refine.assign_noise(z, cents).collect())
