"""Array helpers that run inside tasks: Arrow text batches as bytes, word bounds, rolling hashes.

A polynomial hash of any span comes from one running sum over the bytes (or words) of a chunk:
``H[i] = sum(value[j] * P**j for j < i)`` modulo 2**64, so a span is ``(H[end] - H[start]) / P**start``.
``P`` is odd and so has an inverse. Results are mixed, because low bits of such sums are weak.
Whole words and lines of any length are hashed by ``word_hash``.
A chunk holds whole texts of about ``CHUNK_BYTES``; a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from firmatlas.llm.worker import kept

CHUNK_BYTES = 1 << 20
#: Bytes of a word beyond which it is digested. Sums modulo 2**64 have spans of two letters, from 1,024 on,
#: that differ and have equal sums whatever the base is.
LONG_WORD = 256
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a benchmark word: digits, letters a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**64; the table grows by doubling."""
    tables = kept(("powers",), dict)
    table = tables.get(base)
    if table is None:
        table = np.ones(1, U64)
    while len(table) < n:
        step = U64(pow(base, len(table), 1 << 64))
        table = np.concatenate([table, table * step])
    tables[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers, with a leading zero."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of each span; spans of different length differ by their length too."""
    raw = (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]
    return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word or line of a chunk: of short ones by running sums, of long ones a digest of their bytes."""
    out = span_hash(running(data), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def texts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of a text column: first row, row after the last, bytes, row offsets into the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes for which ``inside`` holds, by row."""
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = inside[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    start = np.flatnonzero(mask[1:-1] & (~mask[:-2] | border[:-1]))
    end = np.flatnonzero(mask[1:-1] & (~mask[2:] | border[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def windows(hashes: np.ndarray, row: np.ndarray, size: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every window of ``size`` words within a row.

    A row with some words but fewer than ``size`` gives one window of all its words.
    """
    counts = np.bincount(row, minlength=rows)
    first = np.cumsum(counts) - counts
    prefix = running(hashes)
    at = np.arange(len(hashes))
    full = at + size <= (first + counts)[row]
    short = (counts[row] < size) & (at == first[row])
    start = np.flatnonzero(full | short)
    end = np.minimum(start + size, (first + counts)[row[start]])
    return span_hash(prefix, start, end), row[start], start


def batches(function, schema: pa.Schema):
    """A mapInArrow body: ``function(batch)`` yields column lists for ``schema``."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)],
                    schema=schema,
                )

    return run


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column from values in row order and the number of them per row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(values))
