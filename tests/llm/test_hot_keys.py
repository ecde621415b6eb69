"""Keys that hold a third of all rows and rows that repeat a doc_id, in joins, line dedup and near dedup."""

import hashlib

from pyspark.sql import functions as F

from readlake.llm import common, line_dedup, near_dedup
from test_operators import low, prose

LINE = "A line that very many documents share"


def test_join_counted_equals_a_left_join_and_spreads_hot_keys(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 900).alias("a"), F.lit(1).cast("long").alias("b")).cache()
    counted = common.cut(rows.where("a % 2 = 1").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("last")))
    want = sorted(map(tuple, rows.join(counted.drop("n"), ["a", "b"], "left").select("id", "a", "b", "last").collect()), key=str)
    for most in (1, 8, 4096):
        found = common.join_counted(rows, counted, ["a", "b"], "n", ["last"], F.xxhash64("id"), most)
        assert found.columns == ["id", "a", "b", "last"] and sorted(map(tuple, found.collect()), key=str) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # without any adaptive split, no task gets much more than its share
        found = common.join_counted(rows, counted, ["a", "b"], "n", ["last"], F.xxhash64("id"), 8)
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and max(sizes) < 1.4 * 1000


def brute_lines(rows):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    least = lambda i: -(2**63) if i is None else i
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(least(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and least(i) != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def lines_of(docs):
    return sorted(((r["doc_id"], r["dedup_lines"]["n_lines"], r["dedup_lines"]["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in line_dedup.keep_lines(docs).collect()), key=str)


def test_a_line_needs_distinct_documents(spark):
    rows = [(1, LINE), (1, LINE + "\nmore"), (2, LINE), (3, "another line of enough length"), (3, "another line of enough length"), (4, None), (4, ""), (None, LINE.upper() + "\nx")]
    for some in (rows[:-1], rows, rows + rows):
        assert lines_of(spark.createDataFrame(some, "doc_id long, text string")) == brute_lines(some)
    assert all(x[2] == 0 for x in brute_lines(rows[:-1])) and any(x[2] for x in brute_lines(rows))


def test_a_line_that_a_third_of_the_documents_hold(spark):
    rows = [(i, (LINE + "\n" if i % 3 == 0 else "") + f"own line of document {i % 250} here\nshort") for i in range(1500)] + [(None, LINE)] * 500
    assert lines_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute_lines(rows)


def test_a_third_of_the_rows_are_one_class(spark):
    rows = [(i, prose(1, 80) if i % 3 == 0 else prose(i, 30)) for i in range(3, 900)] + [(None, prose(1, 80))] * 20 + [(5, prose(1, 80))] * 20
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        copy = r["n_shingles"] == 76
        assert r["component_id"] == (None if copy else r["doc_id"]) and r["kept"] == (r["doc_id"] is None or not copy)


def test_recall_of_links_at_the_bound(spark):
    """Pairs of 120 shingles just over the bound (5 of 9 lost shingles each side): all tables miss a pair with probability under 1e-3."""
    rows = []
    for k in range(400):
        w = prose(1000 + k, 104, 5000).split()
        copy = list(w)
        copy[40], copy[41] = f"y{k}", f"z{k}"  # 6 of 100 shingles: 94 / 106
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(copy))]
        copy = list(w)
        copy[30] = copy[60] = f"q{k}"  # 10 of 100 shingles: 90 / 110 = 0.818
        rows.append((10_000 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 80, 10).collect()}
    missed = sum(got[2 * k + 1] != 2 * k for k in range(400)) + sum(got[10_000 + k] != 2 * k for k in range(400))
    assert missed <= 4
