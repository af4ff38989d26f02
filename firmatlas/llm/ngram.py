"""Language-model scores from a bigram trie in Elias-Fano form.

Tokens are words and one end per text. The model is a bigram model with a Dirichlet prior:
p(w | v) = (c(vw) + PRIOR * p1(w)) / (c(v) + PRIOR), and p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). It sums
to one over all words and an unknown one, whatever the context, and the first token's context is a start.

Neither counts nor texts meet in one place. Texts are cut into chunks, and each chunk is written once as
its distinct words and its tokens. Chunks send their distinct words, and their distinct bigrams, with
training counts to shards; a shard adds the counts up and answers each chunk. Shards of bigrams keep the
counts as a trie (``eliasfano``) with two-byte codes in memory-mapped levels, and every bigram that a chunk
asks for, of a training text or not, is found in it by successor search within its context. Then each
chunk meets its answers and scores its texts. The number of shards grows with the number of tokens, so a
shard holds about ``PER_SHARD`` entries; a word or bigram is one entry per chunk, however frequent it is,
and the successors of a context are dealt over more shards the more shards there are.

Counts of words are exact. Counts of bigrams above 127 are rounded to codes of 8 % steps, without an upper
limit, and bigrams are told apart by 32 bits of each word's hash.

Defined cases: null and empty texts have one token, the end; rows without doc_id belong to training as
``held_out`` says; rows that repeat a doc_id are scored each by its own text, and each is learned from; an
empty table gives an empty result; columns besides doc_id, text and held_out are not read.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmatlas.llm import kernel as K
from firmatlas.llm.eliasfano import Trie, counted
from firmatlas.llm.store import written

CHUNK, PIECE, PER_SHARD = 8 << 20, 64 << 10, 2_000_000
PRIOR = 4.0
END, START = np.uint64(0x1E9D5A3C7F20B841), np.uint64(0x7C3B9E1D52F0A686)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed body; bytes of equal weight are put together first."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        body = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        parts.append(struct.pack("<cBII", a.dtype.kind.encode(), a.dtype.itemsize, len(a), len(body)) + body)
    return b"".join(parts)


def unpack(body: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(body):
        kind, size, n, packed = struct.unpack_from("<cBII", body, at)
        at += struct.calcsize("<cBII")
        kind = np.dtype(f"{kind.decode()}{size}")
        raw = pa.decompress(body[at : at + packed], decompressed_size=n * size, codec="zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += packed
    return out


def gaps(rising: np.ndarray) -> np.ndarray:
    """Differences of a rising array, which compress better than it does; ``np.cumsum`` undoes it."""
    return np.diff(rising, prepend=rising.dtype.type(0))


def risen(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _rows(chunk: int, kind: int, shard: int, body: bytes):
    """A body as rows of at most PIECE bytes."""
    for part in range(0, max(len(body), 1), PIECE):
        yield chunk, kind, shard, part // PIECE, body[part : part + PIECE]


PIECES = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("part", pa.int32()), ("body", pa.binary())])
PIECES_DDL = "chunk long, kind int, shard long, part int, body binary"


def _record(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), PIECES)], schema=PIECES)


def _bodies(batches):
    """Whole bodies from rows that come in order of (chunk, kind, shard, part)."""
    key, held = None, []
    for batch in batches:
        for chunk, kind, shard, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "shard", "body"))):
            if key != (chunk, kind, shard) and held:
                yield (*key, b"".join(held))
                held = []
            key = (chunk, kind, shard)
            held.append(body)
    if held:
        yield (*key, b"".join(held))


def _chunks(batches):
    """Tokens of the texts, about CHUNK bytes at a time, as rows of a new chunk."""

    def chunk(held: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(held).combine_chunks()
        parts, lengths = [], []
        for first, stop, data, offsets in K.texts(whole.column("text")):
            data = K.LOWER[data]
            start, end, row = K.words(data, offsets, ~K.SPACE)
            length = np.bincount(row, minlength=stop - first) + 1
            ends = np.cumsum(length) - 1
            tokens = np.empty(len(start) + len(ends), np.uint64)
            inside = np.ones(len(tokens), bool)
            inside[ends] = False
            tokens[inside], tokens[ends] = K.word_hash(data, start, end), END
            parts.append(tokens)
            lengths.append(length)
        distinct, index = np.unique(np.concatenate(parts), return_inverse=True)
        ids = whole.column("doc_id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        held_out = whole.column("held_out").to_numpy().astype(bool)
        body = pack(ids.fill_null(0).to_numpy(), known, held_out, np.concatenate(lengths).astype(np.uint32), gaps(distinct), index.astype(np.uint32))
        return _record(_rows(uuid.uuid4().int >> 65, 0, 0, body))

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= CHUNK:
            yield chunk(held)
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield chunk(held)


def _training(held_out: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.repeat(~held_out, length)


def _bigrams(length: np.ndarray, distinct: np.ndarray, index: np.ndarray):
    """Key of the (context, word) pair at every token: 32 bits of each hash."""
    top = distinct >> np.uint64(32)
    word = top[index]
    context = np.empty(len(word), np.uint64)
    context[1:] = word[:-1]
    context[np.cumsum(length) - length] = START >> np.uint64(32)
    return (context << np.uint64(32)) | word


def _bigram_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    spread = np.uint64(max(1, shards // 8))
    return shard_of(K.mix((keys >> np.uint64(32)) * np.uint64(0x9E3779B1) + K.mix(keys & np.uint64(0xFFFFFFFF)) % spread), shards)


def _distinct_bigrams(length, distinct, index, shards: int):
    """Sorted distinct keys of a chunk, their order by shard, and where each shard begins in that order."""
    keys, inverse = np.unique(_bigrams(length, distinct, index), return_inverse=True)
    shard = _bigram_shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    return keys, inverse, order, np.searchsorted(shard[order], np.arange(shards + 1))


def _asked(shards: int):
    """What a chunk asks shards: kind 1 words, kind 2 bigrams, with training counts."""

    def run(batches):
        for chunk, _, _, body in _bodies(batches):
            _, _, held_out, length, distinct, index = unpack(body)
            length, distinct = length.astype(np.int64), risen(distinct)
            weight = _training(held_out, length)
            n = np.bincount(index, weights=weight, minlength=len(distinct)).astype(np.uint32)
            edge = np.searchsorted(shard_of(distinct, shards), np.arange(shards + 1))
            for s in np.flatnonzero(edge[1:] > edge[:-1]):
                part = slice(edge[s], edge[s + 1])
                yield _record([(chunk, 1, int(s), 0, pack(gaps(distinct[part]), n[part]))])
            keys, inverse, order, edge = _distinct_bigrams(length, distinct, index, shards)
            n = np.bincount(inverse, weights=weight, minlength=len(keys)).astype(np.uint32)
            for s in np.flatnonzero(edge[1:] > edge[:-1]):
                part = order[edge[s] : edge[s + 1]]
                own = keys[part]
                context, first, run_length = np.unique(own >> np.uint64(32), return_index=True, return_counts=True)
                yield _record([(chunk, 2, int(s), 0, pack(gaps(context.astype(np.uint32)), run_length.astype(np.uint32), own.astype(np.uint32), n[part]))])

    return run


ANSWERS = pa.schema([*PIECES, ("n", pa.int64()), ("v", pa.int64())])
ANSWERS_DDL = PIECES_DDL + ", n long, v long"


def _answers(table: pa.Table) -> pa.Table:
    """One shard of one kind: adds up the counts of all chunks and answers each."""
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    chunks = table.column("chunk").to_pylist()
    bodies = [unpack(b) for b in table.column("body").to_pylist()]
    if kind == 1:
        keys, counts = np.concatenate([risen(b[0]) for b in bodies]), np.concatenate([b[1] for b in bodies])
        sizes = [len(b[0]) for b in bodies]
    else:
        keys = np.concatenate([(np.repeat(risen(b[0]), b[1]).astype(np.uint64) << np.uint64(32)) | b[2] for b in bodies])
        counts = np.concatenate([b[3] for b in bodies])
        sizes = [len(b[2]) for b in bodies]
    distinct, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
    n = v = 0
    if kind == 1:
        n, v = int(total.sum()), int((total > 0).sum())
        answer = total.astype(np.uint64 if total.max(initial=0) >> 32 else np.uint32)[inverse]
    else:
        own = total > 0
        trie = Trie(distinct[own] >> np.uint64(32), distinct[own] & np.uint64(0xFFFFFFFF), total[own])
        codes = trie.lookup(distinct >> np.uint64(32), distinct & np.uint64(0xFFFFFFFF))
        answer = codes[inverse]
    rows, at = [], 0
    for chunk, size in zip(chunks, sizes):
        rows.extend(_rows(chunk, kind, shard, pack(answer[at : at + size])))
        at += size
    columns = [pa.array(c, t.type) for c, t in zip(zip(*rows), PIECES)]
    first = np.arange(len(rows)) == 0
    return pa.Table.from_arrays([*columns, pa.array(first * n), pa.array(first * v)], schema=ANSWERS)


def _scores(shards: int, total: int, known_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(body: bytes, words: list, bigrams: list) -> pa.RecordBatch:
        ids, known, held_out, length, distinct, index = unpack(body)
        length, distinct = length.astype(np.int64), risen(distinct)
        count = np.concatenate(words).astype(np.float64)
        p1 = (count + 0.1) / (total + 0.1 * (known_words + 1))
        keys, inverse, order, _ = _distinct_bigrams(length, distinct, index, shards)
        pair = np.empty(len(keys))
        pair[order] = counted(np.concatenate(bigrams))
        starts = np.cumsum(length) - length
        context = np.empty(len(index))
        context[1:] = count[index[:-1]]
        # The start is the context of as many tokens as there are ends in training.
        context[starts] = count[np.searchsorted(distinct, END)]
        p = (pair[inverse] + PRIOR * p1[index]) / (context + PRIOR)
        # Rounded counts may exceed the exact count of their context.
        p = np.minimum(p, 1.0)

        def add(values):
            return np.add.reduceat(values, starts) if len(starts) else values

        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=~known), pa.array(held_out), pa.array(length.astype(np.int64)), pa.array(add((count[index] > 0).astype(np.int64))),
                pa.array(add(np.log10(p1)[index])), pa.array(add(np.log10(p))),
            ], schema=schema,
        )

    def run(batches):
        chunk, body, words, bigrams = None, b"", [], []
        for own, kind, _, part in _bodies(batches):
            if kind == 0:
                if chunk is not None:
                    yield score(body, words, bigrams)
                chunk, body, words, bigrams = own, part, [], []
            else:
                (words if kind == 1 else bigrams).append(unpack(part)[0])
        if chunk is not None:
            yield score(body, words, bigrams)

    return run


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    ``docs`` has doc_id, text and held_out; rows that are not held out are learned from.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    chunks = written(docs.mapInArrow(_chunks, PIECES_DDL), "chunks")
    size = chunks.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    # A token takes about two bytes of a chunk's body, its share of the distinct words included three.
    shards = max(4, -(-size // (3 * PER_SHARD)))
    whole = chunks.repartition("chunk").sortWithinPartitions("chunk", "kind", "shard", "part")
    asked = whole.mapInArrow(_asked(shards), PIECES_DDL)
    answers = asked.groupBy("kind", "shard").applyInArrow(_answers, ANSWERS_DDL)
    answers = written(answers, "answers")
    total, words = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    meeting = chunks.union(answers.select(*chunks.columns)).repartition("chunk").sortWithinPartitions("chunk", "kind", "shard", "part")
    found = meeting.mapInArrow(_scores(shards, total, words), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
