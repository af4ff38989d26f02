import base64
import gzip
import hashlib
import json
import os

from helpers import prose
from pyspark.sql import functions as F

from firmatlas.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages():
    rows = [(i, f"http://h{i % 3}.example/é?q={i}%20x\r\n", f"<p>{prose(i % 7, 20 + i)}</p>" if i % 4 else f"<b>{i % 8}</b>") for i in range(40)]
    return [*rows, (50, None, None), (51, "u", ""), (None, "u", "<b>0</b>"), (60, "u", prose(1, 20_000)), (70, "v", prose(1, 20_000)), rows[3], (None, None, None)]


def test_round_trip(spark, tmp_path):
    folder = str(tmp_path / "archives")
    df = spark.createDataFrame([(*r, "x", 1) for r in pages()], SCHEMA + ", record_type string, payload int").repartition(3)
    warc.write_archives(df, folder, file_bytes=3000)
    got = warc.read_archives(spark, folder).collect()
    first = {}
    for page_id, _, html in pages():
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    assert len(got) == len(pages())
    expected = []
    for page_id, url, html in pages():
        body = (html or "").encode()
        head = first.get(html or "")
        revisit = head is not None and page_id != head
        expected.append((str(page_id), url, "revisit" if revisit else "response", head if revisit else None, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), None if revisit else body))
    mine = [(str(r.page_id), r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(mine, key=str) == sorted(expected, key=str)


def test_small_payloads_are_all_responses(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA), str(tmp_path / "a"), min_bytes=20)
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 20)
    assert any(r.record_type == "revisit" for r in got)


def test_predicates_reach_the_reader(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA), folder)
    df = warc.read_archives(spark, folder)
    everything = df.collect()
    for condition, test in (
        (F.col("record_type") == "revisit", lambda r: r.record_type == "revisit"),
        (F.col("page_id").isin(1, 2, 60), lambda r: r.page_id in (1, 2, 60)),
        (F.col("url").startswith("http://h1"), lambda r: (r.url or "").startswith("http://h1")),
        ((F.col("record_type") == "response") & (F.col("payload_bytes") > 50), lambda r: r.record_type == "response" and r.payload_bytes > 50),
        (F.col("refers_to").isNotNull(), lambda r: r.refers_to is not None),
    ):
        assert sorted(map(str, df.filter(condition).collect())) == sorted(str(r) for r in everything if test(r))
    reader = warc.WarcReader({"path": folder})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.tests == [("record_type", "in", ("revisit",))]


def test_unwanted_payloads_are_not_decoded(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame([(1, "u", prose(1, 50_000)), (2, "u", "x")], SCHEMA).coalesce(1), folder)
    reader = warc.WarcReader({"path": folder, "payload": "false"})
    read = 0

    class Counting:
        def __init__(self, source):
            self.source = source

        def seek(self, at):
            self.source.seek(at)

        def read(self, n):
            nonlocal read
            read += n
            return self.source.read(n)

    for part in reader.partitions():
        size = os.path.getsize(part.uri)
        with open(part.uri, "rb") as source:
            assert [r["payload"] for r in warc.records(Counting(source), reader.wanted, False)] == [None, None]
    assert read < size / 5


def test_archives_are_plain_gzip(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame([(1, "u", "<p>é</p>")], SCHEMA), folder)
    name = json.load(open(f"{folder}/{warc.MANIFEST}"))["files"][0]
    raw = gzip.open(f"{folder}/{name}").read()
    head, _, block = raw.partition(b"\r\n\r\n")
    length = int(head.decode().split("Content-Length: ")[1].split("\r\n")[0])
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and block[length:] == b"\r\n\r\n"


def test_files_outside_the_manifest_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame([(1, "u", "x")], SCHEMA), folder)
    (tmp_path / "a" / "pages-lost.warc.gz").write_bytes(warc.member(b"half a record"))
    assert warc.read_archives(spark, folder).count() == 1


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).collect() == []
