"""An n-gram trie in Elias-Fano form, in memory-mapped levels.

A sorted sequence is split into low bits, which are packed, and high bits, which become a bit vector of
unary gaps; the i-th value needs the place of the i-th one bit. The first level of the trie holds the
context words, with pointers to where the successors of each begin. The second level holds successor
words. To make them one rising sequence, each is stored relative to its context: the largest word so far
is added to all words of the next contexts. A query finds its context, takes the two pointers, and
searches its word, moved by the same amount, for the first value not below it within that range.

Counts are kept as two-byte codes: exact up to 127, then by logarithmic steps, however large they are.
"""

from __future__ import annotations

import tempfile

import numpy as np

EXACT, STEP = 127, 1.08


def quantised(counts: np.ndarray) -> np.ndarray:
    """Codes of counts; 0 stays 0."""
    far = EXACT + np.round(np.log(np.maximum(counts, EXACT) / EXACT) / np.log(STEP))
    return np.where(counts <= EXACT, counts, far).astype(np.uint16)


def counted(codes: np.ndarray) -> np.ndarray:
    """Counts that codes stand for."""
    return np.where(codes <= EXACT, codes, EXACT * STEP ** (codes.astype(np.float64) - EXACT))


class Levels:
    """Arrays in one unlinked temporary file that is mapped into memory."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()
        self.size = 0

    def keep(self, array: np.ndarray) -> np.ndarray:
        if not array.nbytes:
            return array
        self.file.seek(self.size)
        self.file.write(np.ascontiguousarray(array).tobytes())
        self.file.flush()
        out = np.memmap(self.file, array.dtype, "r", self.size, array.shape)
        self.size += -(-array.nbytes // 64) * 64
        return out


class Sequence:
    """A non-decreasing sequence of integers below 2**62."""

    def __init__(self, values: np.ndarray, levels: Levels):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.width = max(0, (top // max(self.n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << self.width) - 1)
        bits = ((low[:, None] >> np.arange(self.width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if self.width else np.zeros((self.n, 0), np.uint8)
        self.low = levels.keep(np.append(np.packbits(bits.ravel(), bitorder="little"), np.zeros(16, np.uint8)))
        ones = (values >> np.uint64(self.width)).astype(np.int64) + np.arange(self.n)
        unary = np.zeros(int(ones[-1]) + 1 if self.n else 0, np.uint8)
        unary[ones] = 1
        packed = np.packbits(unary, bitorder="little")
        packed = np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).view(np.uint64)
        self.high = levels.keep(packed)
        self.ranks = levels.keep(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        place = np.searchsorted(self.ranks, i, "right") - 1
        left = i - self.ranks[place]
        word, within = self.high[place], np.zeros(len(i), np.int64)
        for size in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(word & np.uint64((1 << size) - 1)).astype(np.int64)
            past = left >= here
            left -= np.where(past, here, 0)
            word = np.where(past, word >> np.uint64(size), word)
            within += np.where(past, size, 0)
        high = place * 64 + within - i
        out = high.astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bit = i * self.width
            byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
            raw = np.zeros(len(i), np.uint64)
            for k in range(8):
                raw |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
            value = raw >> shift
            more = self.low[byte + 8].astype(np.uint64)
            value |= np.where(shift > 0, more << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
            out |= value & np.uint64((1 << self.width) - 1)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) whose value is not below the asked one, or hi."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            middle = (lo[open_] + hi[open_]) >> 1
            below = self[middle] < value[open_]
            lo[open_] = np.where(below, middle + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], middle)


class Trie:
    """Counts of (context, word) pairs, given as sorted distinct 32-bit contexts and words."""

    def __init__(self, context: np.ndarray, word: np.ndarray, counts: np.ndarray):
        levels = Levels()
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        first = np.flatnonzero(new)
        self.contexts = Sequence(context[first], levels)
        self.pointers = Sequence(np.append(first, len(context)), levels)
        group = np.cumsum(new) - 1
        last = word[np.append(first[1:], len(context)) - 1].astype(np.uint64) + np.uint64(1) if len(first) else first.astype(np.uint64)
        shift = np.concatenate([[np.uint64(0)], np.cumsum(last)]).astype(np.uint64)
        self.shifts = Sequence(shift, levels)
        self.words = Sequence(word.astype(np.uint64) + shift[group] if len(word) else word, levels)
        self.codes = levels.keep(quantised(counts))
        self.size = levels.size

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of the asked pairs, 0 for those that the trie does not hold."""
        out = np.zeros(len(context), np.uint16)
        if not self.contexts.n:
            return out
        zero = np.zeros(len(context), np.int64)
        at = self.contexts.successor(zero, zero + self.contexts.n, context.astype(np.uint64))
        held = np.flatnonzero(at < self.contexts.n)
        held = held[self.contexts[at[held]] == context[held].astype(np.uint64)]
        at = at[held]
        lo, hi = self.pointers[at].astype(np.int64), self.pointers[at + 1].astype(np.int64)
        value = word[held].astype(np.uint64) + self.shifts[at]
        place = self.words.successor(lo, hi, value)
        some = np.flatnonzero(place < hi)
        some = some[self.words[place[some]] == value[some]]
        out[held[some]] = self.codes[place[some]]
        return out
