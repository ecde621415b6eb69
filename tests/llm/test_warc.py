"""WARC archives: round trips, push-down, skipped payloads, foreign files, repeats of pages."""

import gzip
import hashlib
import io
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from readlake.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(pages):
    payloads = [(i, (html or "").encode()) for i, _, html in pages]
    first = defaultdict(list)
    for i, data in payloads:
        if i is not None and len(data) >= 100:
            first[data].append(i)
    out = []
    for i, data in payloads:
        least = min(first[data], default=None) if len(data) >= 100 else None
        again = least is not None and least != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least if again else None))
    return sorted(out, key=str)


def back(spark, path):
    df = warc.read_pages(spark, path)
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_pages_round_trip(spark, tmp_path, compression):
    long = "é" * 60
    pages = [(5, "http://a/\r\nX: y", long), (3, None, long), (9, "http://c", long), (None, "http://n", long), (4, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", None), (8, "u", ""), (8, "u", "z" * 200), (8, "u", "z" * 200),
             (10, "u", "WARC/1.1\r\n\r\n" * 20), (11, "u", "\r\n\r\n" + "<p>" * 100_000), (None, "u", "q" * 150)]
    df = spark.createDataFrame(pages, SCHEMA).withColumns({"digest": F.lit(1), "first": F.lit("x")}).repartition(3)
    warc.write(warc.page_records(df), str(tmp_path / "w"), compression=compression)
    assert back(spark, str(tmp_path / "w")) == brute(pages)
    assert not (tmp_path / "w" / "_attempts" / "x").exists()
    html = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, str(tmp_path / "w")).where("warc_type = 'response' AND payload_digest IS NOT NULL").collect()}
    assert html["urn:page:11"] == pages[11][2] and html["urn:page:10"] == pages[10][2]


def test_hot_payload(spark, tmp_path):
    """A third of the pages may share one payload."""
    pages = [(i, f"http://{i}", "same " * 40 if i % 3 == 0 else f"page {i} " * 30) for i in range(600)]
    warc.write(warc.page_records(spark.createDataFrame(pages, SCHEMA).repartition(7)), str(tmp_path / "w"), max_file_bytes="20000")
    assert back(spark, str(tmp_path / "w")) == brute(pages)
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) > 7


def test_empty_table(spark, tmp_path):
    (tmp_path / "w").mkdir()
    warc.write(warc.page_records(spark.createDataFrame([], SCHEMA)), str(tmp_path / "w"))
    assert back(spark, str(tmp_path / "w")) == []


def some(path, spark, compression="gzip"):
    rows = [("urn:a", "response", "http://x/1", b"payload one " * 50), ("urn:b", "revisit", "http://x/2", None), ("urn:c", "resource", "http://y/3", b"raw bytes \x00\xff"), ("urn:d", "response", "http://y/4", b"")]
    warc.write(spark.createDataFrame(rows, "record_id string, warc_type string, target_uri string, payload binary").coalesce(1), path, compression=compression)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_filters_are_pushed_and_answer_as_spark_does(spark, tmp_path, compression):
    some(str(tmp_path / "w"), spark, compression)
    df = warc.read(spark, str(tmp_path / "w"))
    plain = spark.createDataFrame(df.collect(), df.schema)
    for where in ("warc_type = 'response'", "warc_type IN ('revisit', 'resource')", "NOT warc_type = 'response'", "target_uri LIKE 'http://x%'", "target_uri LIKE '%/4'", "refers_to IS NULL", "content_length > 100", "content_length <= 100 AND warc_type <=> 'response'", "refers_to = 'q'", "NOT (refers_to <=> 'q')", "http_length = 600", "target_uri LIKE '%y/%'"):
        got, want = df.where(where), plain.where(where)
        assert sorted(r["record_id"] for r in got.collect()) == sorted(r["record_id"] for r in want.collect()), where
    plan = df.where("warc_type = 'response' AND target_uri LIKE 'http://x%'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # the source answers both
    assert "Filter (" in df.where("http_length = 600")._jdf.queryExecution().executedPlan().toString()


def test_unwanted_blocks_are_not_read(spark, tmp_path, monkeypatch):
    """Headers only: of gzip members without a wanted block nothing is inflated past the header, and the file is left by a seek."""
    some(str(tmp_path / "w"), spark)
    (path,) = (tmp_path / "w").glob("*.gz")
    filters = warc.Filters()
    assert filters.take(ds.EqualTo(("warc_type",), "resource")) and not filters.take(ds.EqualTo(("payload",), b""))
    taken = []
    monkeypatch.setattr(warc, "_exactly", lambda stream, n, at: taken.append(n) or stream.read(n))
    with io.BufferedReader(open(path, "rb", buffering=0)) as file:
        rows = [*warc.records(file, "f", filters, True)]
    assert [r["record_id"] for r in rows] == ["urn:c"] and taken == [12]
    taken.clear()
    with io.BufferedReader(open(path, "rb", buffering=0)) as file:
        assert len([*warc.records(file, "f", warc.Filters(), False)]) == 4 and not taken


def foreign(n=3):
    body = b"line\r\n\r\nWARC/1.0 not a record"
    return [b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\nX-Folded: a\r\n b\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (i, len(body), body) for i in range(n)], body


def test_archives_of_others(spark, tmp_path):
    """Members without the length field, one member over several records, plain files; a file is a path too."""
    made, body = foreign()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in made))
    (tmp_path / "b.warc").write_bytes(b"".join(made))
    (tmp_path / "notes.txt").write_text("no archive")
    got = warc.read(spark, str(tmp_path)).select("record_id", "payload", F.col("headers")["x-folded"].alias("x")).collect()
    assert sorted((r["record_id"], bytes(r["payload"]), r["x"]) for r in got) == sorted(2 * [(f"urn:{i}", body, "a b") for i in range(3)])
    assert warc.read(spark, str(tmp_path), "record_id string").where("record_id = 'urn:1'").count() == 2
    assert warc.read(spark, str(tmp_path / "b.warc"), "record_id string").count() == 3


@pytest.mark.parametrize("cut", [10, 60, 110])
def test_broken_archives_are_errors(tmp_path, cut):
    made, _ = foreign(1)
    for data in (made[0][:cut], zlib.compress(made[0], wbits=31)[: cut // 2]):
        (tmp_path / "x.warc").write_bytes(data)
        with open(tmp_path / "x.warc", "rb") as file, pytest.raises((ValueError, EOFError)):
            [*warc.records(file, "x", warc.Filters(), True)]


def test_failed_attempts_leave_nothing(spark, tmp_path):
    """Only what the driver has commit messages of is in the archive."""
    from pyspark.sql.types import StructType

    writer = warc.WarcWriter(StructType.fromDDL("record_id string"), {"path": str(tmp_path / "w")}, False)
    folder = tmp_path / "w" / "_attempts" / writer.job
    folder.mkdir(parents=True)
    for name in ("lost.warc.gz", "kept.warc.gz"):
        (folder / name).write_bytes(b"")
    writer.commit([warc.Written(["kept.warc.gz"]), None])
    assert [p.name for p in (tmp_path / "w").rglob("*.warc.gz")] == ["kept.warc.gz"]
    with pytest.raises(ValueError, match="no place"):
        warc.WarcWriter(StructType.fromDDL("page_id long"), {"path": "x"}, False)
