"""WARC archives as a Python data source, and web pages written to them without repeated payloads.

Archives are gzip files with one member per record. A member names its own compressed length in a
subfield of the gzip header (``WL``), which other readers pass over, so this reader can go on to the next
record without decoding a payload. The write side rolls files at ``file_bytes``, and the driver commits
a manifest of the files of successful tasks: files of lost or repeated tasks are never read. The read side
plans one partition per archive file of the manifest.

Predicates on record_type, page_id, url, payload_digest and refers_to are pushed down. A reader decodes
only the start of a member until the record's headers end, tests them, and skips the rest of a record
that fails or whose payload is not wanted (option ``payload`` = "false").

Defined cases of ``pages_to_records``: a null html is an empty payload; a page without page_id is a
response unless another page with an id has its payload; rows that repeat page_id and html repeat the
same record; null urls are written without a target URI; an empty table gives an archive folder without
files; further columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)

from firmatlas.llm.store import written

SCHEMA = "record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"
ARROW = pa.schema([
    ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])
MANIFEST = "_manifest.json"
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_COLUMNS = {"record_type", "page_id", "url", "refers_to", "payload_digest"}
#: Bytes that are decoded at a time while a record's headers are looked for.
STEP = 4096


def filesystem(uri: str):
    """File system and path of a folder. Python opens archives itself, so this takes any store that pyarrow knows."""
    return pafs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int = 4) -> bytes:
    """A gzip member that holds its compressed length in an extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    total = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 8) + b"WL" + struct.pack("<HI", 4, total)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(row: dict, date: str) -> bytes:
    """The bytes of a response or revisit record."""
    response = row["record_type"] == "response"
    payload = row["payload"] or b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block += payload if response else b""
    key = f"{row['page_id']}/{row['url']}/{row['payload_digest']}"
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if row["url"] is None else quote(row["url"], safe="/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "WARC-Profile": None if response else PROFILE,
        "X-Page-ID": row["page_id"],
        "X-Refers-To-Page-ID": row["refers_to"],
        "X-Payload-Length": row["payload_bytes"],
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict:
    """The header columns of a record from its header lines."""
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)

    def number(name):
        return int(fields[name]) if name in fields else None

    return {
        "record_type": fields.get("WARC-Type"), "page_id": number("X-Page-ID"), "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "refers_to": number("X-Refers-To-Page-ID"), "payload_bytes": number("X-Payload-Length"),
        "payload_digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
    }


def records(source, wanted, payload: bool) -> Iterator[dict]:
    """Records of an open archive whose headers pass ``wanted``; payloads are decoded only where asked for."""
    start = 0
    while True:
        source.seek(start)
        head = source.read(20)
        if not head:
            return
        if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"WL":
            raise ValueError(f"no record of this writer at byte {start}")
        total = struct.unpack("<I", head[16:20])[0]
        unpacker, text, taken = zlib.decompressobj(-15), b"", 20
        while b"\r\n\r\n" not in text:
            piece = source.read(min(STEP, total - taken))
            if not piece:
                raise ValueError(f"record without end of headers at byte {start}")
            taken += len(piece)
            text += unpacker.decompress(piece)
        lines, _, block = text.partition(b"\r\n\r\n")
        row = parse_headers(lines)
        if wanted(row):
            row["payload"] = None
            if payload and row["record_type"] == "response":
                block += unpacker.decompress(source.read(total - taken))
                row["payload"] = block.partition(b"\r\n\r\n")[2][: row["payload_bytes"]]
            yield row
        start += total


@dataclass
class Archive(InputPartition):
    uri: str

    def __init__(self, uri: str):
        self.uri = uri


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 else None
            if column not in HEADER_COLUMNS:
                yield f
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "known", None))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            else:
                self.tests.append((column, "in", (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            own = row[column]
            if own is None or (kind == "in" and own not in value) or (kind == "starts" and not own.startswith(value)):
                return False
        return True

    def partitions(self):
        store, folder = filesystem(self.folder)
        with store.open_input_stream(f"{folder}/{MANIFEST}") as source:
            names = json.loads(source.read())["files"]
        return [Archive(f"{self.folder}/{name}") for name in names] or [Archive("")]

    def read(self, partition):
        if not partition.uri:
            return
        store, path = filesystem(partition.uri)
        rows, held = [], 0
        with store.open_input_file(path) as source:
            for row in records(source, self.wanted, self.payload):
                rows.append(row)
                held += len(row["payload"] or b"") + 200
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.file_bytes = int(options.get("file_bytes", 32 << 20))
        self.date = options.get("date", "2024-01-01T00:00:00Z")

    def write(self, iterator):
        store, folder = filesystem(self.folder)
        store.create_dir(folder, recursive=True)
        files: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for at in range(batch.num_rows):
                    row = {name: column[0].as_py() for name, column in zip(batch.schema.names, batch.slice(at, 1).columns)}
                    if out is None:
                        files.append(f"pages-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                    piece = member(record(row, self.date))
                    out.write(piece)
                    size += len(piece)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        store, folder = filesystem(self.folder)
        store.create_dir(folder, recursive=True)
        names = sorted(name for m in messages if m is not None for name in m.files)
        with store.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"files": names}).encode())

    def abort(self, messages):
        """Without a manifest none of the written files is read."""


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it push filters down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _payloads(batches):
    for batch in batches:
        html = batch.column("html").cast(pa.binary()).fill_null(b"").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(html, pa.binary()), pa.array([len(x) for x in html], pa.int64()), pa.array([digest(x) for x in html], pa.string())],
            names=["page_id", "url", "payload", "payload_bytes", "payload_digest"],
        )


def pages_to_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A record per page. Of equal payloads of min_bytes or more, the smallest page_id responds, others revisit it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.mapInArrow(_payloads, "page_id long, url string, payload binary, payload_bytes long, payload_digest string")
    first = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("uses"))
    first = written(first.filter("uses > 1").select("payload_digest", "first_page"), "first-pages")
    joined = rows.join(first, "payload_digest", "left")
    revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "page_id", "url",
        F.when(revisit, F.col("first_page")).alias("refers_to"), "payload_bytes", "payload_digest",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def measured(batches):
    """Response records with length and digest of the payload as it was read, in place of their headers."""
    for batch in batches:
        payload = batch.column("payload").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), pa.array([len(x) for x in payload], pa.int64()), pa.array([digest(x) for x in payload], pa.string()), batch.column("record_type"), batch.column("refers_to")],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 32 << 20) -> None:
    register(pages.sparkSession)
    pages_to_records(pages, min_bytes).write.format("warc").option("file_bytes", file_bytes).mode("append").save(folder)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)
