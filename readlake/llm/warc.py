"""WARC archives as a Python data source, `warc`, for reading and writing, and pages stored with their repeats as revisits.

Reading. The driver lists the files and packs them into partitions by size; a file is read by one task, record by record. Filters on
the columns that come from a record's header (types, ids, URIs, dates, digests, lengths) are pushed down. A task parses the header first. If the record
fails a filter, or the schema that is asked for has neither `payload` nor `http_length`, the block is passed over: by a seek in plain files, and in gzip files by a
seek over the whole member where its extra field `sl` gives the length (else it is inflated in pieces and thrown away).

Writing. A task writes files of at most `max_file_bytes` and, for gzip, a member for each record with the field `sl`. Files are
written under `_attempts` with names that no other attempt has; the driver moves those of the tasks that succeeded into the folder at the end, so that
a lost executor or a repeated task leaves no record twice. Paths are URIs that pyarrow opens (a local or mounted folder, hdfs, s3, gs).

Defined results: a null payload is empty; a null header is left out; line ends in header values are written as %0D and %0A. A
record whose header is cut short or has no length is an error that names file and place; bytes after the last record too. An
empty folder gives no rows.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from readlake.llm import common as c

SCHEMA = "record_id string, warc_type string, date string, target_uri string, refers_to string, payload_digest string, content_type string, content_length long, http_length long, headers map<string,string>, payload binary"
#: Fixed names of the format.
FIELDS = {
    "record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type",
}
HEADER_COLUMNS = {*FIELDS, "content_length"}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAX_FILE_BYTES, PARTITION_BYTES, MIN_REPEATED = 1 << 30, 128 << 20, 100


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it. Hadoop's name for S3 is not pyarrow's."""
    for theirs in ("s3a://", "s3n://"):
        path = "s3://" + path.removeprefix(theirs) if path.startswith(theirs) else path
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- records


def _member(data: bytes, level: int) -> bytes:
    """A gzip member with its own length and that of the data in the extra field `sl`."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(data) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    if size >= 1 << 32 or len(data) >= 1 << 32:
        head = b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff"
    else:
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: object) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """The bytes of a record. A response's or revisit's payload goes behind HTTP headers; http_length there is that of the whole payload."""
    payload, block = row.get("payload") or b"", b""
    http = row.get("warc_type") in ("response", "revisit")
    if http:
        length = row.get("http_length")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    lines = ["WARC/1.1", *(f"{name}: {_clean(row[column])}" for column, name in FIELDS.items() if row.get(column) is not None)]
    if http and row.get("content_type") is None:
        lines.append("Content-Type: application/http; msgtype=response")
    if row.get("warc_type") == "revisit":
        lines.append(f"WARC-Profile: {IDENTICAL}")
    lines += [f"{_clean(k)}: {_clean(v)}" for k, v in (row.get("headers") or ())]
    lines.append(f"Content-Length: {len(block) + len(payload)}")
    return b"".join(["\r\n".join(lines).encode(), b"\r\n\r\n", block, payload, b"\r\n\r\n"])


class _Inflated(io.RawIOBase):
    """The data of the gzip member that begins here in a file; afterwards the file stands at the next one."""

    def __init__(self, file: io.BufferedReader):
        self.file, self.inflate, self.left = file, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.file.read1(1 << 16)
            if not data:
                raise EOFError("a gzip member is cut short")
            got = self.inflate.decompress(data, len(into))
            if self.inflate.eof:
                self.file.seek(-len(self.inflate.unused_data), io.SEEK_CUR)
            if got:
                into[: len(got)] = got
                return len(got)
        return 0


def _member_length(file: io.BufferedReader) -> int | None:
    """What the field `sl` of the member that begins here says."""
    head = file.peek(24)[:24]
    if len(head) == 24 and head[3] & 4 and head[12:16] == b"sl\x08\x00":
        return struct.unpack("<I", head[16:20])[0]
    return None


def _header(stream: io.BufferedReader, at: str) -> dict[str, str] | None:
    """Names in lower case; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record at {at}")
    out: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError(f"a WARC header is cut short at {at}")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:  # a value goes on
            out[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        out[name] = value.strip()
    if not out.get("content-length", "").isdigit():
        raise ValueError(f"a WARC record without a length at {at}")
    return out


def _exactly(stream: io.BufferedReader, n: int, at: str) -> bytes:
    data = stream.read(n)
    if len(data) < n:
        raise ValueError(f"a WARC block is cut short at {at}")
    return data


def _skip(stream: io.BufferedReader, n: int, at: str) -> None:
    while n:
        n -= len(_exactly(stream, min(n, 1 << 20), at))


def _row(head: dict[str, str]) -> dict:
    row = {column: head.get(name.lower()) for column, name in FIELDS.items()}
    for column in ("record_id", "refers_to"):
        row[column] = row[column] and row[column].removeprefix("<").removesuffix(">")
    return row | {"content_length": int(head["content-length"]), "headers": list(head.items())}


def _with_block(row: dict, block: bytes) -> dict:
    """payload and http_length; the payload of a block that is an HTTP message stands behind its headers."""
    row |= {"payload": block, "http_length": None}
    if (row["content_type"] or "").lower().startswith("application/http"):
        http, _, row["payload"] = block.partition(b"\r\n\r\n")
        for line in http.split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                row["http_length"] = int(value)
    return row


def records(file: io.BufferedReader, name: str, wanted: "Filters", blocks: bool) -> Iterator[dict]:
    """The records of a file that pass the filters; without `blocks`, none is read."""
    while head := file.peek(2)[:2]:
        start = file.tell()
        at = f"{name}, byte {start}"
        packed = head == b"\x1f\x8b"
        length = _member_length(file) if packed else None
        stream = io.BufferedReader(_Inflated(file), 1 << 16) if packed else file
        found = _header(stream, at)
        if found is None:
            if packed:
                raise ValueError(f"an empty gzip member at {at}")
            return
        row = _row(found)
        ok = wanted.keep(row)
        if ok and blocks:
            row = _with_block(row, _exactly(stream, row["content_length"], at))
        if packed:
            if ok and blocks or length is None:
                _skip(stream, 0 if ok and blocks else row["content_length"], at)
                while stream.read(1 << 16):  # line ends, up to the next member
                    pass
            else:
                file.seek(start + length)
        elif not (ok and blocks):
            file.seek(row["content_length"], io.SEEK_CUR)
        if ok:
            yield row


# ---------------------------------------------------------------- the data source


class Filters:
    """Filters on header columns that a task answers before it reads a block."""

    def __init__(self) -> None:
        self.held: list[ds.Filter] = []

    def take(self, f: ds.Filter) -> bool:
        inner = f.child if isinstance(f, ds.Not) else f
        known = (ds.EqualTo, ds.EqualNullSafe, ds.In, ds.IsNull, ds.IsNotNull, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)
        if not isinstance(inner, known) or len(inner.attribute) != 1 or inner.attribute[0] not in HEADER_COLUMNS:
            return False
        self.held.append(f)
        return True

    def keep(self, row: dict) -> bool:
        return all(_holds(f, row) is True for f in self.held)


def _holds(f: ds.Filter, row: dict) -> bool | None:
    """SQL's answer, None for unknown."""
    if isinstance(f, ds.Not):
        return None if (inner := _holds(f.child, row)) is None else not inner
    x = row[f.attribute[0]]
    match f:
        case ds.IsNull():
            return x is None
        case ds.IsNotNull():
            return x is not None
        case ds.EqualNullSafe():
            return x == f.value
        case ds.In():
            return None if x is None else True if x in f.value else None if None in f.value else False
    if x is None or f.value is None:
        return None
    # text is compared by its UTF-8, as Spark does
    a, b = (x.encode(), f.value.encode()) if isinstance(x, str) else (x, f.value)
    match f:
        case ds.EqualTo():
            return a == b
        case ds.GreaterThan():
            return a > b
        case ds.GreaterThanOrEqual():
            return a >= b
        case ds.LessThan():
            return a < b
        case ds.LessThanOrEqual():
            return a <= b
        case ds.StringStartsWith():
            return a.startswith(b)
        case ds.StringEndsWith():
            return a.endswith(b)
        case ds.StringContains():
            return b in a
    raise TypeError(f"{f} was not taken")


@dataclass
class Files(ds.InputPartition):
    paths: list[str]


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters = Filters()

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if not self.filters.take(f):
                yield f

    def partitions(self) -> Sequence[ds.InputPartition]:
        fs, path = _open(self.path)
        if (info := fs.get_file_info(path)).type == pafs.FileType.File:
            found = [info]
        else:
            found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        found = [f for f in found if f.type == pafs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(path) :].split("/")) and f.base_name.endswith((".warc", ".warc.gz"))]
        out: list[Files] = []
        room = 0
        for f in sorted(found, key=lambda f: f.path):
            if not out or f.size > room:
                out.append(Files([]))
                room = self.most
            out[-1].paths.append(f.path)
            room -= f.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        arrow, names = to_arrow_schema(self.schema), self.schema.names
        blocks = bool({"payload", "http_length"} & {*names})
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 18) as file:
                for row in records(file, path, self.filters, blocks):
                    rows.append({n: row.get(n) for n in names})
                    size += 1000 + len(row.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        if unknown := {*schema.names} - {*FIELDS, "http_length", "headers", "payload"}:
            raise ValueError(f"columns that WARC has no place for: {sorted(unknown)}")
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.gzip = options.get("compression", "gzip").lower() == "gzip"
        self.level, self.most = int(options.get("level", 4)), int(options.get("max_file_bytes", MAX_FILE_BYTES))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _open(self.path)
        fs.create_dir(f"{path}/_attempts/{self.job}", recursive=True)
        stem = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = record(row)
                    data = _member(data, self.level) if self.gzip else data
                    if out is None or size + len(data) > self.most:
                        if out:
                            out.close()
                        names.append(f"{stem}-{len(names)}.warc{'.gz' if self.gzip else ''}")
                        out, size = fs.open_output_stream(f"{path}/_attempts/{self.job}/{names[-1]}", compression=None, buffer_size=1 << 20), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _open(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
                if f.type == pafs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")):
                    fs.delete_file(f.path)
        fs.create_dir(path, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{path}/_attempts/{self.job}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What attempts that do not count have left goes."""
        fs, path = _open(self.path)
        if fs.get_file_info(f"{path}/_attempts/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/_attempts/{self.job}")


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records of the archives under a path. A schema without payload and http_length reads headers only."""
    register(spark)
    return spark.read.format("warc").schema(schema).option("path", path).load()


def write(records: DataFrame, path: str, **options: str) -> None:
    """Adds archives to a folder. Columns: those of the reader, but content_length; all may be left out."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").options(path=path, **options).save()


# ---------------------------------------------------------------- pages


def page_records(pages: DataFrame, least: int = MIN_REPEATED, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Records of pages (page_id, url, html): of equal payloads of at least `least` bytes the one of the smallest page_id is a response, the others revisit it.

    A page_id that is null is larger than all others; rows that repeat page_id and payload are responses alike. Payloads are
    compared by SHA-256. Repeats are joined to the smallest page_id of their payload by counted keys, so that a payload of
    which there are very many is broadcast.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # the two halves of the digest that are longs, with which rows are joined
    half = lambda a, b: F.xxhash64(F.substring("digest", a, b))
    rows = rows.withColumns({"a": half(1, 32), "b": half(33, 32), "bytes": F.octet_length("payload").cast("long")})
    counted = rows.where(F.col("bytes") >= least).groupBy("a", "b").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
    found = c.join_counted(rows, c.cut(counted), ["a", "b"], "n", ["first"], F.xxhash64("page_id", "url"))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")) & (F.col("bytes") >= least)
    name = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    return found.select(
        name(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("warc_type"), F.lit(date).alias("date"), F.col("url").alias("target_uri"),
        F.when(again, name(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"), F.col("bytes").alias("http_length"), F.when(~again, F.col("payload")).alias("payload"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to. What a response says is taken from its payload; of revisits no payload is read."""
    page = lambda x: F.regexp_extract(x, r"^urn:page:(-?\d+)$", 1)
    number = lambda x: F.when(page(x) != "", page(x).cast("long"))
    responses = read(spark, path, "record_id string, warc_type string, payload binary").where("warc_type = 'response'")
    responses = responses.select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = read(spark, path, "record_id string, warc_type string, refers_to string, payload_digest string, http_length long").where("warc_type = 'revisit'")
    digest = F.regexp_extract("payload_digest", "^sha256:(.*)$", 1)
    revisits = revisits.select(number("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"), digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives that are written and read back."""
    c.use_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"
    write(page_records(c.table(spark, sf_dir, "pages")), folder)
    return read_pages(spark, folder)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f
"""
