"""Tokens of two tokenizers aligned by bytes, and how often their ids meet in the corpus.

A text with a space before it is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B,
which adds the space itself). Both sets of tokens tile the bytes of a text. The tokens of a chunk of texts
are sorted together by start; the running maximum of their ends breaks them into groups where a start
reaches it, and within a group A and B tokens whose ranges overlap are linked.

How often a pair of ids is linked is counted over the corpus. A chunk is written once, as one packed row of its
texts' tokens, and sends each of its distinct pairs once, with their number. Pairs are added up over
chunks, compared with the highest count of their B id, and sent back to the chunks that asked; each chunk then
meets its answers and makes the rows of its texts. No pair has more rows than there are chunks.

Defined cases: null and empty texts, and texts whose tokens do not give their bytes back (what the piece
vocabulary normalizes, or text that is not valid UTF-8), have no tokens and zeros; strings of special tokens
are plain text; a text of any length is one task's work, beside others of its chunk; rows that repeat a doc_id, or have
none, are aligned each by its own text and all counted; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmatlas.llm.ngram import pack, unpack
from firmatlas.llm.store import scratch, written
from firmatlas.llm.worker import kept

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: how the byte-level vocabulary expects a text to be cut before it is encoded.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of texts per chunk.
CHUNK = 8 << 20
#: Bytes of texts that are encoded and aligned at a time.
STEP = 1 << 20
#: White space of such length is left to the slower of two libraries, which takes it without recursion.
LONG_BLANK = re.compile(r"\s{2000}")


def byte_level() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both vocabularies: ids of texts, and bytes of ids."""

    def __init__(self, folder: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken

        self.path = f"{folder}/{BYTE_BPE}"
        with open(self.path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["id"] for t in model["added_tokens"]}
        table, vocabulary = byte_level(), model["model"]["vocab"]
        ranks = {bytes(table[c] for c in piece): i for piece, i in vocabulary.items() if i not in special}
        self.bpe = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.a_bytes[i] = piece
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.a_size = np.array([len(b) for b in self.a_bytes], np.int64)
        self.b_size = np.array([len(b) for b in self.b_bytes], np.int64)
        self.full = None

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for each text; none where either does not give the bytes back."""
        a_all, b_all = [], []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1)):
            a = self._a(" " + text) if text else []
            want = b" " + text.encode()
            fits = text and b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want
            a_all.append(a if fits else [])
            b_all.append(b if fits else [])
        return a_all, b_all

    def _a(self, text: str) -> list[int]:
        if not LONG_BLANK.search(text):
            return self.bpe.encode_ordinary(text)
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
            self.full.encode_special_tokens = True
        return self.full.encode(text, add_special_tokens=False).ids


def tokenizers(folder: str) -> Tokenizers:
    return kept(("alignment", folder), lambda: Tokenizers(folder))


def groups(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of intervals by start, and the number of each one's group in that order."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def aligned(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of every A and B token, and the links as places of A and B tokens, from the tokens' sizes."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    a_start, b_start = a_end - a_size, b_end - b_size
    order, group = groups(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]))
    own = np.empty(len(order), np.int64)
    own[order] = group
    # B tokens that overlap an A token lie next to each other, within its group.
    first = np.searchsorted(b_end, a_start, "right")
    n = np.searchsorted(b_start, a_end, "left") - first
    a = np.repeat(np.arange(len(a_size)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return own[: len(a_size)], own[len(a_size) :], a, b


_DIGITS = 6


def decimals(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of ids (below 10 ** _DIGITS) from the left, one row each, and how many they are."""
    n = np.ones(len(ids), np.int64)
    for k in range(1, _DIGITS):
        n += ids >= 10**k
    out = np.zeros((len(ids), _DIGITS + 1), np.uint8)
    for place in range(_DIGITS):
        power = np.maximum(n - 1 - place, 0)
        out[:, place] = 48 + ids // 10**power % 10
    return out, n


def _digits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``decimals`` by a table that the process keeps; vocabularies are not larger."""
    cells, n = kept(("decimals",), lambda: decimals(np.arange(1 << 17)))
    return cells[ids], n[ids]


def written_groups(a_ids, b_ids, a_group, b_group) -> tuple[np.ndarray, np.ndarray]:
    """Groups as ``a1,a2|b1;`` in bytes, and where each group ends."""
    side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
    group = np.concatenate([a_group, b_group])
    order = np.lexsort((side, group))
    ids, side, group = np.concatenate([a_ids, b_ids])[order], side[order], group[order]
    cells, n = _digits(ids)
    mark = np.full(len(ids), ord(","), np.uint8)
    last = np.ones(len(ids), bool)
    last[:-1] = group[1:] != group[:-1]
    mark[:-1][(side[:-1] == 0) & (side[1:] == 1)] = ord("|")
    mark[last] = ord(";")
    cells[np.arange(len(ids)), n] = mark
    return cells[np.arange(_DIGITS + 1) <= n[:, None]], np.cumsum(n + 1)[last]


def _digests(a_ids, b_ids, a_group, b_group, group_doc: np.ndarray, docs: int) -> list[str]:
    body, ends = written_groups(a_ids, b_ids, a_group, b_group)
    upto = np.searchsorted(group_doc, np.arange(docs + 1))
    edges = np.concatenate([[0], ends])[upto]
    raw = body.tobytes()
    return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]


CHUNKS = pa.schema([("chunk", pa.int64()), ("body", pa.binary()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
CHUNKS_DDL = "chunk long, body binary, a array<int>, b array<int>, n array<long>"


def _align(texts: list[str], folder: str):
    """Per text: numbers of A and B tokens, groups and links; digests; and its distinct linked pairs of ids with their number."""
    tool = tokenizers(folder)
    a_lists, b_lists = tool.encode(texts)
    a_count, b_count = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_lists, b_lists))
    a_ids, b_ids = (np.fromiter(chain.from_iterable(lists), np.int64, n.sum()) for lists, n in ((a_lists, a_count), (b_lists, b_count)))
    a_group, b_group, a, b = aligned(tool.a_size[a_ids], tool.b_size[b_ids])
    a_doc = np.repeat(np.arange(len(texts)), a_count)
    # Groups follow the texts' order, and each has an A token.
    first = np.flatnonzero(np.diff(a_group, prepend=-1))
    group_doc = a_doc[first]
    counts = (a_count, b_count, np.bincount(group_doc, minlength=len(texts)), np.bincount(a_doc[a], minlength=len(texts)))
    doc, pair = a_doc[a], (a_ids[a] << 32) | b_ids[b]
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    n_pairs = np.bincount(doc[at], minlength=len(texts))
    digests = _digests(a_ids, b_ids, a_group, b_group, group_doc, len(texts))
    return (*counts, n_pairs), digests, pair[at], np.diff(at, append=len(order))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], int]]:
    """doc_ids and texts, about STEP bytes at a time; a longer text is a step of its own."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            text = (raw or b"").decode("utf-8", "replace")
            # What is not UTF-8 would be aligned as other bytes.
            text = text if raw is None or text.encode() == raw else ""
            if texts and size + len(text) > STEP:
                yield ids, texts, size
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts, size


def _chunks(folder: str):
    def chunk(held: list) -> pa.RecordBatch:
        ids = [i for x in held for i in x[0]]
        counts = [np.concatenate([x[1][k] for x in held]).astype(np.uint32) for k in range(5)]
        digests = [d for x in held for d in x[2]]
        n = np.concatenate([x[4] for x in held])
        distinct, index = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
        total = np.bincount(index, weights=n, minlength=len(distinct)).astype(np.int64)
        known = np.array([i is not None for i in ids], bool)
        hashes = np.frombuffer(bytes.fromhex("".join(d or "0" * 64 for d in digests)), np.uint8)
        body = pack(np.array([i or 0 for i in ids], np.int64), known, *counts, index.astype(np.uint32), n.astype(np.uint32), hashes, np.array([len(distinct)], np.uint64))
        a, b = (distinct >> 32).astype(np.int32), (distinct & 0xFFFFFFFF).astype(np.int32)
        row = [[uuid.uuid4().int >> 65], [body], [a], [b], [total]]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(row, CHUNKS)], schema=CHUNKS)

    def run(batches):
        held, size = [], 0
        for ids, texts, n in _steps(batches):
            held.append((ids, *_align(texts, folder)))
            size += n
            if size >= CHUNK:
                yield chunk(held)
                held, size = [], 0
        if held:
            yield chunk(held)

    return run


ROWS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])
ROWS_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finished(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of a chunk's texts from its body and the corpus counts of its pairs."""
    if not left.num_rows:
        return pa.Table.from_pylist([], ROWS)
    ids, known, n_a, n_b, n_groups, n_links, n_pairs, index, n, hashes, size = unpack(left.column("body")[0].as_py())
    pair = (right.column("a").to_numpy().astype(np.int64) << 32) | right.column("b").to_numpy()
    order = np.argsort(pair)
    if len(order) != int(size[0]):
        raise ValueError("a chunk lacks counts of its pairs")
    total, best = right.column("total").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order].astype(bool)
    doc = np.repeat(np.arange(len(ids)), n_pairs)
    times = n.astype(np.int64)

    def by_doc(values):
        out = np.zeros(len(ids), np.int64)
        np.add.at(out, doc, values)
        return out

    digests = [bytes(h).hex() if groups_ else "" for h, groups_ in zip(hashes.reshape(-1, 32), n_groups)]
    columns = [pa.array(ids, mask=~known), *(pa.array(c.astype(np.int64)) for c in (n_a, n_b, n_groups, n_links)), pa.array(by_doc(times * best[index])), pa.array(by_doc(times * total[index])), pa.array(digests, pa.string())]
    return pa.Table.from_arrays(columns, schema=ROWS)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """Corpus count of every pair of ids, and whether it is the highest of its B id."""
    pairs = chunks.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("total"))
    pairs = written(pairs, "pair-counts")
    # One row for each id of the piece vocabulary.
    top = pairs.groupBy("b").agg(F.max("total").alias("top"))
    return pairs.join(top, "b").select("a", "b", "total", (F.col("total") == F.col("top")).alias("best"))


def alignments(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Counts, corpus counts and digest of the aligned tokens of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = written(rows.mapInArrow(_chunks(folder), CHUNKS_DDL), "aligned-chunks")
    counts = written(pair_counts(chunks), "pair-totals")
    asked = chunks.select("chunk", F.explode(F.arrays_zip("a", "b")).alias("p")).select("chunk", "p.a", "p.b")
    answers = written(asked.join(counts, ["a", "b"]), "pair-answers")
    bodies = chunks.select("chunk", "body").groupBy("chunk")
    return bodies.cogroup(answers.select("chunk", "a", "b", "total", "best").groupBy("chunk")).applyInArrow(_finished, ROWS_DDL)


def links(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """a, b, total and best of every pair of ids that the corpus links: a table to map one vocabulary to the other."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession):
        chunks = written(rows.mapInArrow(_chunks(folder), CHUNKS_DDL), "aligned-chunks")
        return written(pair_counts(chunks), "pair-totals", keep=True)
