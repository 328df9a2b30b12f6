"""WARC archives as a Spark data source, `warc`, for reading and writing.

Writing: each task writes gzip archives of one member per record, rolled at `roll_bytes`, under names
that only a commit makes final. A member's header carries its compressed length in the extra field
`sl`, so that a reader can go to the next record without decoding this one.

Reading: the files are planned into partitions of about `partition_bytes` by size. Filters on
record_type, record_id, target_uri, content_length, payload_digest and refers_to are pushed down. Of
each record the headers are decoded first; its payload is decoded only if the filters hold and the
option `payload` is not "false"; otherwise the record is skipped by its length.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from ._shared import shared_path, stored

SCHEMA = "record_type string, record_id string, target_uri string, record_date string, content_length long, payload_bytes long, payload_digest string, refers_to string, payload binary"
_HEADER_COLUMNS = ("record_type", "record_id", "target_uri", "content_length", "payload_digest", "refers_to")
_DATE = "2024-01-01T00:00:00Z"


def _store(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = _DATE) -> bytes:
    """One record. Its block is an HTTP response; that of a revisit ends with the HTTP headers."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member with its own length, and that of what it holds, in the extra field: 64 bits each."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 20 + len(body) + 8
    extra = b"sl" + struct.pack("<HQQ", 16, size, len(data))
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member_size(start: bytes) -> int | None:
    """The length that a member's extra field states, if it does."""
    if len(start) < 24 or not start[3] & 4:
        return None
    end = 12 + struct.unpack_from("<H", start, 10)[0]
    i = 12
    while i + 4 <= end:
        n = struct.unpack_from("<H", start, i + 2)[0]
        if start[i : i + 2] == b"sl" and n in (8, 16):  # others write 32 bits each
            return struct.unpack_from("<I" if n == 8 else "<Q", start, i + 4)[0]
        i += 4 + n
    return None


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def parse_headers(head: bytes) -> dict:
    """The columns that a record's headers give."""
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    digest = found.get("warc-payload-digest")
    return {
        "record_type": found.get("warc-type"),
        "record_id": _bare(found.get("warc-record-id")),
        "target_uri": found.get("warc-target-uri"),
        "record_date": found.get("warc-date"),
        "content_length": int(found.get("content-length", 0)),
        "payload_digest": digest.rpartition(":")[2] if digest else None,
        "refers_to": _bare(found.get("warc-refers-to")),
    }


def _split_http(block: bytes) -> tuple[int | None, bytes]:
    """The length that the HTTP headers state, and what follows them."""
    if not block.startswith(b"HTTP/"):
        return None, block
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value), body
    return None, body


_TESTS = {
    EqualTo: lambda v, f: v is not None and v == f.value,
    EqualNullSafe: lambda v, f: v == f.value,
    In: lambda v, f: v is not None and v in f.value,
    IsNull: lambda v, f: v is None,
    IsNotNull: lambda v, f: v is not None,
    GreaterThan: lambda v, f: v is not None and v > f.value,
    GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    LessThan: lambda v, f: v is not None and v < f.value,
    LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
    StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
    StringEndsWith: lambda v, f: v is not None and v.endswith(f.value),
    StringContains: lambda v, f: v is not None and f.value in v,
}


def read_archive(stream, size: int, filters=(), payload: bool = True, count=None):
    """Records of one archive as dicts of columns. count: gets the number of bytes of payload decoded."""
    at, ahead = 0, 1 << 14
    while at < size:
        stream.seek(at)
        start = stream.read(ahead)
        whole = _member_size(start)
        inflate = zlib.decompressobj(31)
        data, fed = b"", 0
        while b"\r\n\r\n" not in data and not inflate.eof:
            if fed >= len(start):
                more = stream.read(ahead)
                if not more:
                    raise ValueError(f"record at {at} is cut off")
                start += more
            data += inflate.decompress(start[fed : fed + 512])
            fed += 512
        head, _, rest = data.partition(b"\r\n\r\n")
        row = parse_headers(head)
        wanted = all(_TESTS[type(f)](row[f.attribute[0]], f) for f in filters)
        full = wanted and (payload or row["record_type"] == "revisit")
        if full or whole is None:
            while len(start) < (whole or 0):
                more = stream.read(whole - len(start))
                if not more:
                    raise ValueError(f"record at {at} is cut off")
                start += more
            parts = [rest, inflate.decompress(start[fed : whole or len(start)])]
            used = min(len(start), max(fed, whole or len(start)))
            while not inflate.eof:
                more = stream.read(1 << 16)
                if not more:
                    raise ValueError(f"record at {at} is cut off")
                used += len(more)
                parts.append(inflate.decompress(more))
            whole = whole or used - len(inflate.unused_data)
            if full:
                block = b"".join(parts)[: row["content_length"]]
                stated, body = _split_http(block)
                row["payload_bytes"] = len(body) if row["record_type"] != "revisit" else stated
                row["payload"] = body if payload and row["record_type"] != "revisit" else None
                if count:
                    count(len(body))
        if wanted:
            yield row
        at += whole


@dataclass
class Files(InputPartition):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.most = int(options.get("partition_bytes", 64 << 20))
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _HEADER_COLUMNS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.path)
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        found = store.get_file_info(fs.FileSelector(root)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        out: list[list] = []
        total = self.most
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if total + f.size > self.most:
                out.append([])
                total = 0
            out[-1].append((f.path if scheme in ("", "file://") else scheme + f.path, f.size))
            total += f.size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition):
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        types = [{"long": pa.int64(), "binary": pa.binary()}.get(x.split(" ")[1], pa.string()) for x in SCHEMA.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names)

        rows, held = [], 0
        for path, size in partition.files:
            store, at = _store(path)
            with store.open_input_file(at) as f:
                for row in read_archive(f, size, self.filters, self.payload):
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 200
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    """Takes columns record_type, record_id, target_uri, payload_digest, refers_to, payload."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.roll = int(options.get("roll_bytes", 64 << 20))

    def write(self, iterator):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for b in iterator:
            cols = [b.column(c) for c in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to", "payload")]
            for kind, rid, uri, digest, refers, body in zip(*cols):
                data = member(record(kind.as_py(), rid.as_py(), uri.as_py(), body.as_py() or b"", digest.as_py(), refers.as_py()))
                if out is None or size + len(data) > self.roll:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/_{names[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        from pyarrow import fs

        store, root = _store(self.path)
        if self.overwrite and store.get_file_info(root).type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.is_file and f.base_name.endswith(".warc.gz") and not f.base_name.startswith("_"):
                    store.delete_file(f.path)
        for m in messages:
            for n in m.names if m else ():
                store.move(f"{root}/_{n}", f"{root}/{n}")

    def abort(self, messages):
        store, root = _store(self.path)
        for m in messages:
            for n in m.names if m else ():
                store.delete_file(f"{root}/_{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and allows pushed filters, which Spark leaves off for Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store: one without a scheme is of Hadoop's default file system, as everywhere in Spark, and not of
    each executor's own disk."""
    plain = spark._jvm.org.apache.hadoop.fs.Path(path)
    return plain.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(plain).toString()


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(qualified(spark, path))


_ID = "urn:sentrylake:page:"


def write_pages(pages: DataFrame, path: str, least: int = 100) -> None:
    """Writes a record for each row of pages(page_id, url, html).

    Of rows with equal payloads of at least `least` bytes, those with the smallest page_id are responses and
    the others revisit it; shorter payloads, and rows without an id, are responses. Null html is empty, a null
    url is left out. Payloads meet by digest only: the digests are counted first, and the page texts are joined
    to the repeated ones by a join that adaptive execution splits where one digest is very common.
    """
    spark = pages.sparkSession
    register(spark)
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    firsts = stored(firsts, "firsts")
    again = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first"))
    rows.join(firsts, "digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit(_ID), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.col("digest").alias("payload_digest"),
        F.when(again, F.concat(F.lit(_ID), F.col("first").cast("string"))).alias("refers_to"),
        "payload",
    ).write.format("warc").mode("append").save(qualified(pages.sparkSession, path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, and its payload. Bytes and
    digest of a response are those of the payload that was read; those of a revisit are what its headers state."""
    number = lambda c: F.substring_index(F.col(c), ":", -1).try_cast("long")
    response = F.col("record_type") == "response"
    return read_warc(spark, path).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        "payload",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages(page_id, url, html) to an archive in the shared folder and reads it back: a row per row of pages with
    page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty payload; rows without a
    page_id, and repeated ones, are records too, and repeat their record ids; an empty table gives no rows."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_pages(pages, path)
    return read_pages(spark, path).drop("payload")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
