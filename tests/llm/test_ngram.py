import math
from collections import Counter

import numpy as np
import pytest
from helpers import documents, frame, prose, words
from pyspark.sql import functions as F

from firmatlas.llm import ngram
from firmatlas.llm.eliasfano import Levels, Sequence, Trie, counted, quantised


def plain(rows, held):
    tokens = [[*words(t, lower=True), None] for _, t in rows]
    ones, pairs = Counter(), Counter()
    for w, h in zip(tokens, held):
        if not h:
            ones.update(w)
            pairs.update(zip(["<s>", *w[:-1]], w))
    total, kinds, starts = sum(ones.values()), len(ones), ones[None]
    out = []
    for (doc_id, _), w, h in zip(rows, tokens, held):
        p1 = [(ones[x] + 0.1) / (total + 0.1 * (kinds + 1)) for x in w]
        context = [starts, *(ones[x] for x in w[:-1])]
        p = [(pairs[v, x] + ngram.PRIOR * q) / (c + ngram.PRIOR) for v, x, q, c in zip(["<s>", *w[:-1]], w, p1, context)]
        out.append((doc_id, h, len(w), sum(ones[x] > 0 for x in w), total, sum(map(math.log10, p1)), sum(map(math.log10, p))))
    return out


def check(spark, rows):
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in rows], clashing=True).withColumn("held_out", F.coalesce(F.col("doc_id") % 10 == 3, F.lit(False)))
    got = ngram.scored(df).collect()
    held = [i is not None and i % 10 == 3 for i, _ in rows]
    expected = plain(rows, held)
    assert len(got) == len(expected)
    def order(r):
        return str(r[0]), r[2], r[3], round(r[5], 6)
    for mine, true in zip(sorted(map(tuple, got), key=order), sorted(expected, key=order)):
        assert mine[:5] == true[:5]
        assert mine[5] == pytest.approx(true[5], rel=1e-9) and mine[6] == pytest.approx(true[6], rel=0.02, abs=0.01 * true[2])


def test_edge_cases(spark):
    check(spark, [r[:2] for r in documents()])


def test_many_chunks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(ngram, "CHUNK", 2000)
    monkeypatch.setattr(ngram, "PIECE", 500)
    monkeypatch.setattr(ngram, "PER_SHARD", 2000)
    check(spark, [(i, prose(i % 70, 10 + i % 50, 60)) for i in range(200)])


def test_probabilities_sum_to_one():
    ones, pairs = Counter("abbbcc"), Counter({("a", "b"): 1, ("a", "c"): 2})
    ones["a"] = 3
    total, kinds = sum(ones.values()), len(ones)
    p1 = {w: (n + 0.1) / (total + 0.1 * (kinds + 1)) for w, n in ones.items()} | {"unknown": 0.1 / (total + 0.1 * (kinds + 1))}
    assert sum((pairs["a", w] + ngram.PRIOR * q) / (3 + ngram.PRIOR) for w, q in p1.items()) == pytest.approx(1)


def test_empty_table(spark):
    assert ngram.scored(frame(spark, []).withColumn("held_out", F.lit(False))).collect() == []


def test_sequences_and_trie():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (7, 1 << 40), (3000, 1 << 33), (3000, 1000), (3000, 1)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        at = rng.permutation(n)
        assert (Sequence(values, Levels())[at] == values[at]).all()
    keys = np.unique((rng.integers(0, 300, 9000) << 32 | rng.integers(0, 1 << 32, 9000)).astype(np.uint64))
    counts = rng.integers(1, 100, len(keys))
    trie = Trie(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), counts)
    asked = np.concatenate([keys, rng.integers(0, 1 << 41, 9000).astype(np.uint64)])
    known = dict(zip(keys.tolist(), counts.tolist()))
    assert trie.lookup(asked >> np.uint64(32), asked & np.uint64(0xFFFFFFFF)).tolist() == [known.get(k, 0) for k in asked.tolist()]
    assert trie.size < 7 * len(keys)


def test_codes():
    n = np.arange(0, 100_000)
    back = counted(quantised(n))
    assert (back[:128] == n[:128]).all() and (np.abs(back[1:] / n[1:] - 1) < 0.045).all()


def test_codes_of_large_counts():
    n = np.unique(np.geomspace(1, 1e10, 5000).astype(np.int64))
    assert (np.abs(counted(quantised(n)) / n - 1) < 0.045).all()
    trie = Trie(np.zeros(len(n), np.uint64), np.arange(len(n)).astype(np.uint64), n)
    back = counted(trie.lookup(np.zeros(len(n), np.uint64), np.arange(len(n)).astype(np.uint64)))
    assert (np.abs(back / n - 1) < 0.045).all()


@pytest.mark.parametrize("asked", [False, True])
def test_large_counts_of_many_chunks(asked):
    # Three chunks have the pair (5, 7) so often that the sum does not fit 32 bits.
    body = ngram.pack(*(np.array([x], np.uint32) for x in (5, 1, 7, 4_000_000_000)), np.array([asked]))
    rows = [(chunk, 2, 0, 0, body) for chunk in range(3)]
    got = ngram._answers(ngram.pa.Table.from_batches([ngram._record(rows)]))
    back = [counted(ngram.unpack(b)[0])[0] for b in got.column("body").to_pylist()]
    assert back == pytest.approx([12e9] * 3, rel=0.045)


def test_training_pairs_are_found_by_successor_search(monkeypatch):
    # All of the pairs come from training texts; each is looked up in the trie, and none is read by its place.
    looked = []
    own = Trie.lookup
    monkeypatch.setattr(Trie, "lookup", lambda self, context, word: looked.extend(zip(context.tolist(), word.tolist())) or own(self, context, word))
    body = ngram.pack(np.array([5, 1], np.uint32), np.array([2, 1], np.uint32), np.array([7, 9, 2], np.uint32), np.array([3, 0, 200], np.uint32))
    got = ngram._answers(ngram.pa.Table.from_batches([ngram._record([(chunk, 2, 0, 0, body)]) for chunk in range(2)]))
    assert sorted(looked) == [(5, 7), (5, 9), (6, 2)]
    for packed in got.column("body").to_pylist():
        assert counted(ngram.unpack(packed)[0]) == pytest.approx([6, 0, 400], rel=0.045)


def test_pack():
    arrays = [np.arange(5, dtype=np.uint32), np.zeros(0, np.int64), np.array([True, False]), np.array([2**63], np.uint64)]
    back = ngram.unpack(ngram.pack(*arrays))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True))
