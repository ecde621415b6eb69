import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ["purity_report", "majority_vote", "fuzzy_anchor_join", "refine_labels", "consensus_vote", "stream_vote", "founder_metadata", "best_match_identity", "block_ids", "metric_bundle"]


def plain(x):
    return round(x, 5) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", FEW)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(str(plain(r[i])) for i in at) for r in rel.fetchall())
    assert sorted(tuple(str(plain(r[c])) for c in cols) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
