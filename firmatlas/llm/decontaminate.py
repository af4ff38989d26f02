"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words of digits, letters and characters beyond ASCII. Every
``size`` consecutive words of a benchmark item are a window; an item of fewer words is one window.
The hashes of all windows are broadcast with a number for each, tasks look up every window of the training
words in them, and each hit is verified on the words themselves before it counts (a window of more than
``LONG_GRAM`` bytes on a digest of them). Which items hold a window stays in a table and is joined to the
hits after the scan, once for each distinct set of windows that a document holds.

The broadcast holds at most ``max_windows`` windows. A larger benchmark is dealt by hash into as many
sets as that needs. The training rows are then numbered in one copy, which is scanned once per set; only
numbers and hit words leave these scans, and they are united by number.

Defined cases: null or empty texts have no words, no hits and are kept; an item without words has no
window; an item without item_id marks words but names no item; repeated items count once; rows that
repeat a doc_id are separate rows; empty tables give empty results, an empty benchmark gives no hits;
further columns, whatever their names, are passed on (``cleaned``) or not read (``scan``).
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmatlas.llm import kernel as K
from firmatlas.llm.store import scratch, written

MAX_WINDOWS = 400_000
#: Bytes of a window's words that the broadcast holds; of longer ones it holds a digest.
LONG_GRAM = 512
RUN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words long, runs array<struct<first: long, last: long, start: long, end: long>>, windows array<long>"


def _tokens(data, offsets):
    data = K.LOWER[data]
    start, end, row = K.words(data, offsets, K.ALNUM)
    return data, start, end, row, K.running(K.word_hash(data, start, end))


def _gram(words: list[bytes]) -> bytes:
    gram = b" ".join(words)
    return gram if len(gram) <= LONG_GRAM else b"\0" + sha256(gram).digest()


def _window_rows(size: int):
    def one(batch):
        for first, stop, data, offsets in K.texts(batch.column("text")):
            data, start, end, row, prefix = _tokens(data, offsets)
            rows = stop - first
            counts = np.bincount(row, minlength=rows)
            limit = np.cumsum(counts)[row]
            at = np.arange(len(row))
            head = (at + size <= limit) | ((counts[row] < size) & (at == limit - counts[row]))
            lo = np.flatnonzero(head)
            hi = np.minimum(lo + size, limit[lo])
            hashes = K.span_hash(prefix, lo, hi)
            raw = data.tobytes()
            grams = [_gram([raw[start[i] : end[i]] for i in range(a, b)]) for a, b in zip(lo, hi)]
            ids = batch.column("item_id").slice(first, rows).take(pa.array(row[lo]))
            yield [ids, hashes.view(np.int64), pa.array(grams, pa.binary()), (hi - lo).astype(np.int32)]

    return K.batches(one, pa.schema([("item_id", pa.string()), ("hash", pa.int64()), ("gram", pa.binary()), ("length", pa.int32())]))


def windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows of the benchmark items (hash, gram, length, window), and the items that hold each (window, item_id)."""
    rows = items.select(F.col("item_id").cast("string"), "text").mapInArrow(_window_rows(size), "item_id string, hash long, gram binary, length int")
    rows = written(rows.distinct(), "benchmark-windows")
    grams = written(rows.select("hash", "gram", "length").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    return grams, rows.dropna().join(grams, ["hash", "gram", "length"]).select("window", "item_id")


def _scan(shared, whole: bool):
    """(key, text) rows to (key, n_words, runs of hit words, windows that occur); without ``whole`` only rows with hits."""

    def one(batch):
        hashes, grams, lengths = shared.value
        for first, stop, data, offsets in K.texts(batch.column("text")):
            data, start, end, row, prefix = _tokens(data, offsets)
            rows = stop - first
            counts = np.bincount(row, minlength=rows)
            begin = np.cumsum(counts) - counts
            limit = np.cumsum(counts)[row]
            edge = np.zeros(len(row) + 1, np.int64)
            found: list[set] = [set() for _ in range(rows)]
            raw = data.tobytes()
            for length in lengths:
                lo = np.flatnonzero(np.arange(len(row)) + length <= limit)
                if not len(lo):
                    continue
                key = K.span_hash(prefix, lo, lo + length)
                place = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
                for i in lo[hashes[place] == key]:
                    window = grams.get(_gram([raw[start[j] : end[j]] for j in range(i, i + length)]))
                    if window is not None:
                        edge[i] += 1
                        edge[i + length] -= 1
                        found[row[i]].add(window)
            hit = np.cumsum(edge[:-1]) > 0
            same = np.zeros(len(row), bool)
            same[1:] = row[1:] == row[:-1]
            before = np.concatenate([[False], hit[:-1]])[: len(hit)] & same
            after = np.concatenate([(hit & same)[1:], [False]])[: len(hit)]
            runs: list[list] = [[] for _ in range(rows)]
            for a, b in zip(np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)):
                home = row[a]
                runs[home].append({"first": int(a - begin[home]), "last": int(b + 1 - begin[home]), "start": int(start[a] - offsets[home]), "end": int(end[b] - offsets[home])})
            out = pa.RecordBatch.from_arrays(
                [batch.column("key").slice(first, rows), pa.array(counts.astype(np.int64)), pa.array(runs, RUN), pa.array([sorted(x) for x in found], pa.list_(pa.int64()))],
                names=["key", "n_words", "runs", "windows"],
            )
            yield out if whole else out.filter(pa.array([bool(x) for x in found]))

    return lambda source: (out for batch in source for out in one(batch))


def _united(source):
    """Runs of several scans of one text as runs that neither touch nor overlap."""
    for batch in source:
        out = []
        for runs in batch.column("runs").to_pylist():
            whole: list[dict] = []
            for run in sorted(runs, key=lambda x: x["first"]):
                if whole and run["first"] <= whole[-1]["last"]:
                    if run["last"] > whole[-1]["last"]:
                        whole[-1] |= {"last": run["last"], "end": run["end"]}
                else:
                    whole.append(run)
            out.append(whole)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_words"), pa.array(out, RUN), batch.column("windows")], names=["key", "n_words", "runs", "windows"])


def _share(grams: DataFrame):
    rows = grams.toArrow()
    hashes = np.unique(rows.column("hash").to_numpy().view(np.uint64))
    known = dict(zip(rows.column("gram").to_pylist(), rows.column("window").to_pylist()))
    return grams.sparkSession.sparkContext.broadcast((hashes, known, sorted(set(rows.column("length").to_pylist()))))


def _marked(docs: DataFrame, grams: DataFrame, max_windows: int) -> DataFrame:
    """Each row of docs as a struct ``row``, with n_words, n_hit, numbers of the windows that occur and hit byte spans."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    parts = max(1, -(-grams.count() // max_windows))
    if parts == 1:
        found = docs.select(row.alias("key"), "text").mapInArrow(_scan(_share(grams), True), f"key {docs.schema.simpleString()}, {FOUND}").withColumnRenamed("key", "row")
    else:
        rows = written(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("key")), "scan-rows", keep=True)
        hits = None
        for part in range(parts):
            shared = _share(grams.filter(F.pmod("hash", F.lit(parts)) == part))
            some = rows.select("key", "row.text").mapInArrow(_scan(shared, part == 0), f"key long, {FOUND}")
            some = written(some, "scan-hits")
            shared.destroy()
            hits = some if hits is None else hits.union(some)
        found = hits.groupBy("key").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.flatten(F.collect_list("windows"))).alias("windows")
        )
        found = rows.join(written(found.mapInArrow(_united, f"key long, {FOUND}"), "scan-united", keep=True), "key").drop("key")
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda total, x: total + x["last"] - x["first"])
    spans = F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return found.select("row", "n_words", n_hit.alias("n_hit"), "windows", spans.alias("spans"))


def scan(docs: DataFrame, items: DataFrame, size: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (their ids as sorted strings) and spans per row of docs."""
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            grams, holders = windows(items, size)
            found = _marked(docs.select("doc_id", "text"), grams, max_windows)
            key = F.when(F.size("windows") > 0, F.sha2(F.array_join(F.col("windows").cast("array<string>"), ","), 256))
            found = written(found.select("row.doc_id", "n_words", "n_hit", "windows", "spans", key.alias("key")), "scan-found", keep=True)
            sets = found.dropna(subset=["key"]).groupBy("key").agg(F.any_value("windows").alias("windows"))
            names = sets.select("key", F.explode("windows").alias("window")).join(holders, "window")
            names = written(names.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items")), "scan-items", keep=True)
        none = F.array().cast("array<string>")
        columns = ["doc_id", "n_words", "n_hit", "items", "spans"]
        hit = found.dropna(subset=["key"]).join(names, "key", "left").withColumn("items", F.coalesce("items", none))
        return written(found.filter("key is null").withColumn("items", none).select(*columns).union(hit.select(*columns)), "scan", keep=True)


def cleaned(docs: DataFrame, items: DataFrame, size: int = 10, mode: str = "documents", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without contaminated rows, or with mode "spans" without the hit spans of their texts."""
    with scratch(docs.sparkSession):
        found = _marked(docs, windows(items, size)[0], max_windows)
    if mode == "documents":
        return found.filter("n_hit = 0").select("row.*")
    data = F.encode("row.text", "UTF-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda x: x["end"]))
    ends = F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.octet_length("row.text").cast("long")))
    pieces = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.decode(F.substring(data, x["s"].cast("int") + 1, (x["e"] - x["s"]).cast("int")), "UTF-8"))
    text = F.when(F.col("n_hit") > 0, F.array_join(pieces, "")).otherwise(F.col("row.text"))
    return found.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
