"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte is removed that lies in a string of ``length`` bytes which also starts anywhere else, in the
same text or another. Texts are compared as UTF-8 bytes; strings never cross texts.

Sampling. Of the ``KGRAM``-byte strings in each window of ``length`` bytes, the one with the smallest hash
is the window's anchor, so equal windows have equal anchors at equal distances. An anchor is the anchor
of neighbouring windows; these are cut into cells of ``CELL`` windows by their distance to it. All windows
of a cell share its core, and the cell's bytes are their union. So windows are only compared where the
anchor occurs twice, then where the core occurs twice; and where all bytes of a cell occur twice, all of
its windows are repeated. What is left are cells with the same core and different bytes, at the edges of
repeated passages.

Suffix sort. The suffixes of these cells that start a window are sorted: by their first eight bytes, and
where these tie by a mergesort whose comparisons find the common extension of two suffixes with a binary
search over prefix polynomial hashes, and then look at one byte. Neighbours in the order that extend over
``length`` bytes are repeats once their bytes have been compared as well. A core with very many different
cells is dealt over several blocks; each block is sorted by itself, and what it holds is united with the
other blocks by the windows' hashes, counting each block once. No block holds more than about ``BLOCK``
cells, however often a passage occurs.

Prefix hashes are computed anew in each of three passes over the texts, as they would take eight bytes for
each byte of text. Which keys a later pass needs is passed on as a bitmap of fixed size; keys that get
through by chance are sorted out by the counts that follow.

Defined cases: null is an empty text; a text shorter than ``length`` has no strings and stays; rows that
repeat doc_id and text are copies of each other; an empty table gives an empty result; columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmatlas.llm import kernel as K
from firmatlas.llm.membership import bitmap, inside
from firmatlas.llm.store import scratch, written

LENGTH, KGRAM, CELL, BLOCK = 400, 128, 32, 4096


def _sliding_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of keys[i : i + width] for each i with a full window."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, length: int, kgram: int):
    """Anchor position, hash, first and last window start, and row of each anchor of a chunk."""
    none = np.zeros(0, np.int64)
    size = np.diff(offsets)
    if len(data) < length or not (size >= length).any():
        return none, none.view(np.uint64), none, none, none
    at = np.arange(len(data) - kgram + 1)
    hashes = K.span_hash(prefix, at, at + kgram)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    chosen = (_sliding_minimum(keys, length - kgram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    some = np.flatnonzero(size >= length)
    count = size[some] - length + 1
    row = np.repeat(some, count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + offsets[row]
    chosen = chosen[start]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return chosen[first], hashes[chosen[first]], start[first], start[last], row[first]


def cells(place, low, high, prefix, length: int, kgram: int, cell: int):
    """Cells of anchors: owner index, first and last window start, core key and content key."""
    near, far = (place - high) // cell, (place - low) // cell
    count = far - near + 1
    owner = np.repeat(np.arange(len(place)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + near[owner]
    nearest = number * cell
    farthest = np.minimum(nearest + cell - 1, length - kgram)
    p = place[owner]
    lo, hi = np.maximum(low[owner], p - farthest), np.minimum(high[owner], p - nearest)
    core = K.mix(K.span_hash(prefix, p - nearest, p - farthest + length) + number.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    content = K.mix(K.span_hash(prefix, lo, hi + length) + (lo - p + farthest).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return owner, lo, hi, core, content


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common extension of the suffixes at a and b, up to limit, by binary search over hashes."""
    inverse = K.powers(K.INVERSE, len(prefix))
    low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = (prefix[a + middle] - prefix[a]) * inverse[a] == (prefix[b + middle] - prefix[b]) * inverse[b]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _before(data, prefix, a, b, limit: int, equal: bool) -> np.ndarray:
    """Whether the suffix at a sorts before the one at b; ``equal`` is the answer for equal ones."""
    both = common_extension(prefix, a, b, limit)
    full = both >= limit
    step = np.where(full, 0, both)
    return np.where(full, equal, data[a + step] < data[b + step])


def suffix_sort(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes at start, each ``limit`` bytes long, within their groups."""
    head = np.zeros(len(start), np.uint64)
    for i in range(8):
        head = (head << np.uint64(8)) | data[start + i].astype(np.uint64)
    order = np.lexsort((head, group))
    start, head, group = start[order], head[order], group[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (head[1:] != head[:-1]) | (group[1:] != group[:-1])
    begin = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    length = np.bincount(np.cumsum(fresh) - 1)[np.cumsum(fresh) - 1] if len(start) else begin
    local = np.arange(len(start)) - begin
    width = 1
    while len(start) and width < length.max():
        # Every element finds its rank in the sibling run; both runs of a pair are sorted already.
        run = local // width
        sibling = (run ^ 1) * width
        low = np.zeros(len(start), np.int64)
        high = np.clip(length - sibling, 0, width)
        left = (run & 1) == 0
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            other = start[begin[open_] + sibling[open_] + middle]
            # Elements of the left run go before equal ones of the right run.
            passed = ~_before(data, prefix, start[open_], other, limit, True) & ~left[open_]
            passed |= left[open_] & _before(data, prefix, other, start[open_], limit, False)
            passed |= ~left[open_] & _before(data, prefix, other, start[open_], limit, True)
            low[open_] = np.where(passed, middle + 1, low[open_])
            high[open_] = np.where(passed, high[open_], middle)
        target = begin + (run // 2) * 2 * width + (local - run * width) + low
        moved, moved_order = np.empty_like(start), np.empty_like(order)
        moved[target], moved_order[target] = start, order
        start, order = moved, moved_order
        width *= 2
    return order


def repeats(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Class number of each suffix: equal for suffixes whose ``limit`` bytes are equal, checked on the bytes."""
    order = suffix_sort(data, prefix, start, group, limit)
    at, own = start[order], group[order]
    same = np.zeros(len(at), bool)
    if len(at) > 1:
        near = np.flatnonzero(own[1:] == own[:-1])
        alike = common_extension(prefix, at[near], at[near + 1], limit) >= limit
        near = near[alike]
        rows = np.lib.stride_tricks.sliding_window_view(data, limit)
        for i in range(0, len(near), 4096):
            part = near[i : i + 4096]
            same[part + 1] = (rows[at[part]] == rows[at[part + 1]]).all(axis=1)
    number = np.empty(len(at), np.int64)
    number[order] = np.cumsum(~same) - 1
    return number


class _Pass:
    """What the three passes over the texts share."""

    def __init__(self, length: int):
        self.length, self.kgram, self.cell = length, min(KGRAM, length), CELL

    def chunks(self, batch):
        for first, stop, data, offsets in K.texts(batch.column("text")):
            prefix = K.running(data)
            yield first, stop, data, offsets, prefix, anchors(data, offsets, prefix, self.length, self.kgram)

    def anchor_counts(self):
        def one(batch):
            for *_, (_, hashes, _, _, _) in self.chunks(batch):
                key, n = np.unique(hashes, return_counts=True)
                yield [key.view(np.int64), n.astype(np.int64)]

        return K.batches(one, pa.schema([("anchor", pa.int64()), ("n", pa.int64())]))

    def cell_rows(self, shared):
        def one(batch):
            for first, stop, data, offsets, prefix, (place, hashes, low, high, row) in self.chunks(batch):
                keep = inside(shared.value, hashes)
                place, low, high, row = place[keep], low[keep], high[keep], row[keep]
                owner, lo, hi, core, content = cells(place, low, high, prefix, self.length, self.kgram, self.cell)
                home = row[owner]
                ids, keys = (batch.column(c).slice(first, stop - first).take(pa.array(home)) for c in ("doc_id", "text_key"))
                yield [ids, keys, (lo - offsets[home]), (hi - offsets[home]), core.view(np.int64), content.view(np.int64)]

        return K.batches(one, pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("core", pa.int64()), ("content", pa.int64())]))

    def cell_bytes(self, shared_anchors, shared_cores):
        def one(batch):
            for first, stop, data, offsets, prefix, (place, hashes, low, high, row) in self.chunks(batch):
                keep = inside(shared_anchors.value, hashes)
                place = place[keep]
                owner, lo, hi, core, content = cells(place, low[keep], high[keep], prefix, self.length, self.kgram, self.cell)
                keep = np.flatnonzero(inside(shared_cores.value, core))
                _, some = np.unique(np.column_stack([core[keep], content[keep]]), axis=0, return_index=True)
                keep = keep[some]
                raw = data.tobytes()
                body = [raw[a : b + self.length] for a, b in zip(lo[keep], hi[keep])]
                distance = (lo - place[owner])[keep]
                yield [core[keep].view(np.int64), content[keep].view(np.int64), distance.astype(np.int32), pa.array(body, pa.binary())]

        return K.batches(one, pa.schema([("core", pa.int64()), ("content", pa.int64()), ("distance", pa.int32()), ("body", pa.binary())]))

    def sorted_blocks(self):
        """Suffix sort of whole blocks; rows come in order of (core, block)."""
        length = self.length

        def sort(rows):
            core, content, distance, block, blocks, body = rows
            sizes = np.array([len(b) for b in body], np.int64)
            data = np.frombuffer(b"".join(body), np.uint8)
            at = np.cumsum(sizes) - sizes
            count = sizes - length + 1
            owner = np.repeat(np.arange(len(body)), count)
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = at[owner] + offset
            prefix = K.running(data)
            # Equal windows have the same core, block and distance to the anchor.
            group = K.mix(core[owner].view(np.uint64) + K.mix((block[owner] * 4096 + distance[owner] + offset).astype(np.uint64)))
            number = repeats(data, prefix, start, group, length)
            alone = np.bincount(number)[number] == 1
            hot = blocks[owner] > 1
            window = K.span_hash(prefix, start, start + length).view(np.int64)
            found = np.flatnonzero(~alone | hot)
            counts = np.bincount(owner[found], minlength=len(body))
            return [core.astype(np.int64), content.astype(np.int64), blocks, block, K.lists(offset[found].astype(np.int32), counts), K.lists(alone[found], counts), K.lists(window[found], counts)]

        schema = pa.schema([
            ("core", pa.int64()), ("content", pa.int64()), ("blocks", pa.int64()), ("block", pa.int64()),
            ("offsets", pa.list_(pa.int32())), ("alone", pa.list_(pa.bool_())), ("windows", pa.list_(pa.int64())),
        ])

        def run(batches):
            held: list = []
            n = 0

            def flush(part):
                whole = pa.Table.from_batches(part).combine_chunks()
                columns = [whole.column(c).to_numpy() for c in ("core", "content", "distance", "block", "blocks")]
                out = sort([*columns, whole.column("body").to_pylist()])
                return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)

            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    part = batch.slice(at, BLOCK)
                    held.append(part)
                    n += part.num_rows
                    at += part.num_rows
                    if n < 2 * BLOCK:
                        continue
                    # Only whole blocks are sorted; the last one may go on in the next batch.
                    whole = pa.Table.from_batches(held).combine_chunks()
                    core, block = whole.column("core").to_numpy(), whole.column("block").to_numpy()
                    edge = np.flatnonzero((core != core[-1]) | (block != block[-1]))
                    if len(edge):
                        cut = int(edge[-1]) + 1
                        yield flush(whole.slice(0, cut).to_batches())
                        held, n = whole.slice(cut).to_batches(), whole.num_rows - cut
            if n:
                yield flush(held)

        return run


SPANS = "core long, content long, blocks long, block long, offsets array<int>, alone array<boolean>, windows array<long>"


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text_key and the byte spans (start, end) that are removed, for texts that lose any."""
    spark, work = docs.sparkSession, _Pass(length)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").filter(F.octet_length("text") >= length)
    texts = docs.select("text")
    counts = texts.mapInArrow(work.anchor_counts(), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
    twice = spark.sparkContext.broadcast(bitmap(counts, "anchor"))
    rows = docs.mapInArrow(work.cell_rows(twice), "doc_id long, text_key long, lo long, hi long, core long, content long")
    rows = written(rows, "cells")
    contents = written(rows.groupBy("core", "content").agg(F.count(F.lit(1)).alias("n")), "contents")
    blocks = (F.floor((F.col("different") - 1) / BLOCK) + 1).alias("blocks")
    mixed = contents.groupBy("core").agg(F.count(F.lit(1)).alias("different")).filter("different > 1").select("core", blocks)
    mixed = written(mixed, "mixed-cores")
    cores = spark.sparkContext.broadcast(bitmap(mixed, "core"))
    body = texts.mapInArrow(work.cell_bytes(twice, cores), "core long, content long, distance int, body binary")
    body = written(body.dropDuplicates(["core", "content"]), "cell-bytes").join(mixed, "core")
    body = body.withColumn("block", F.pmod("content", "blocks"))
    body = body.repartition("core", "block").sortWithinPartitions("core", "block", "content")
    found = written(body.select("core", "content", "distance", "block", "blocks", "body").mapInArrow(work.sorted_blocks(), SPANS), "sorted")
    local = found.select("core", "content", F.explode(F.arrays_zip("offsets", "alone")).alias("w")).filter("not w.alone").select("core", "content", "w.offsets")
    spread = found.filter("blocks > 1").select("core", "content", "block", F.explode(F.arrays_zip("offsets", "alone", "windows")).alias("w"))
    spread = written(spread.select("core", "content", "block", "w.*"), "hot-windows")
    shared = spread.groupBy("windows").agg(F.min("block").alias("b0"), F.max("block").alias("b1")).filter("b0 < b1").select("windows")
    across = spread.filter("alone").join(written(shared, "hot-shared"), "windows").select("core", "content", "offsets")
    edges = local.union(across).groupBy("core", "content").agg(F.collect_set("offsets").alias("offsets"))
    whole = contents.join(edges, ["core", "content"], "left").select("core", "content", (F.col("n") > 1).alias("whole"), "offsets").filter("whole or offsets is not null")
    whole = written(whole, "repeats")
    hits = rows.join(whole, ["core", "content"])
    starts = F.when(F.col("whole"), F.array(F.struct(F.col("lo").alias("start"), (F.col("hi") + length).alias("end")))).otherwise(
        F.transform("offsets", lambda o: F.struct((F.col("lo") + o).alias("start"), (F.col("lo") + o + length).alias("end")))
    )
    return hits.select("doc_id", "text_key", F.explode(starts).alias("span")).distinct().groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def _rest(batch):
    for first, stop, data, offsets in K.texts(batch.column("text")):
        rows = stop - first
        raw = data.tobytes()
        n_removed, n_spans, kept, digest = [], [], [], []
        for i, spans in enumerate(batch.column("spans").slice(first, rows).to_pylist()):
            text = raw[offsets[i] : offsets[i + 1]]
            merged: list[list[int]] = []
            for span in spans or ():
                if merged and span["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span["end"])
                else:
                    merged.append([span["start"], span["end"]])
            pieces, at = [], 0
            for a, b in merged:
                pieces.append(text[at:a])
                at = b
            rest = b"".join([*pieces, text[at:]])
            n_removed.append(len(text) - len(rest))
            n_spans.append(len(merged))
            kept.append(rest)
            digest.append(hashlib.sha256(rest).hexdigest())
        yield [batch.column("doc_id").slice(first, rows), np.diff(offsets), n_removed, n_spans, digest, pa.array(kept, pa.binary())]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _split(shared, members: bool):
    """Rows whose doc_id may lose bytes, or the others; a row without doc_id may."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            maybe = inside(shared.value, ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(maybe if members else ~maybe))

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal runs), kept_sha256 and the kept bytes of every row of docs.

    Texts that lose nothing are not shuffled: a bitmap of fixed size tells most of them.
    """
    with scratch(docs.sparkSession):
        spans = written(removed_spans(docs, length), "spans", keep=True)
    spans = spans.select(F.col("doc_id").alias("id"), F.col("text_key").alias("tk"), "spans")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(spans, "id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = rows.mapInArrow(_split(shared, True), "doc_id long, text string").withColumn("text_key", F.xxhash64("text"))
    some = some.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("tk")), "left").select("doc_id", "text", "spans")
    others = rows.mapInArrow(_split(shared, False), "doc_id long, text string").withColumn("spans", F.lit(None).cast(some.schema["spans"].dataType))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return some.mapInArrow(K.batches(_rest, RESULT), ddl).union(others.mapInArrow(K.batches(_rest, RESULT), ddl))
