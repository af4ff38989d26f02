import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, frame, prose

from firmatlas.llm import kernel as K
from firmatlas.llm import substrings


def plain(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, data):
        hit = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                hit[s : s + length] = [True] * length
        rest = bytes(x for x, h in zip(b, hit) if not h)
        spans = sum(h and not before for h, before in zip(hit, [False, *hit]))
        out.append((doc_id, len(b), sum(hit), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, length):
    got = substrings.without_repeats(frame(spark, [(i, t, "en", "s", 0) for i, t in rows]), length).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, length)


@pytest.mark.parametrize("length", [60, 150, 400])
def test_edge_cases(spark, length):
    check(spark, [r[:2] for r in documents()], length)


def test_passages_at_many_places(spark):
    passage = prose(1, 120)
    rows = [(i, f"{prose(i + 10, i % 40)} {passage[i % 90 :]} {prose(i + 80, i % 30)}") for i in range(60)]
    check(spark, rows, 400)


def test_blocks_of_a_frequent_core_are_united(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 3)
    passage = prose(1, 120)
    ends = [prose(i % 9 + 10, 30) for i in range(40)]
    check(spark, [(i, f"{prose(i % 7, 20)} {passage} {e}") for i, e in enumerate(ends)], 400)


def test_empty_table(spark):
    assert substrings.without_repeats(frame(spark, [])).collect() == []


def test_suffix_sort_is_lexicographic():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1500:2500] = data[:1000]
    start = rng.permutation(2500)
    group = start % 3
    order = substrings.suffix_sort(data, K.running(data), start, group, 400)
    raw = data.tobytes()
    keys = [(int(group[i]), raw[start[i] : start[i] + 400]) for i in order]
    assert keys == sorted(keys)
    number = substrings.repeats(data, K.running(data), start, group, 400)
    classes = {}
    for i, n in enumerate(number):
        classes.setdefault((int(group[i]), raw[start[i] : start[i] + 400]), set()).add(int(n))
    assert all(len(c) == 1 for c in classes.values()) and len({n for c in classes.values() for n in c}) == len(classes)


def test_a_hash_collision_is_seen_in_the_bytes(monkeypatch):
    data = np.frombuffer(prose(3, 400).encode(), np.uint8)
    start = np.array([0, 700])
    # With a constant hash all extensions seem equal.
    number = substrings.repeats(data, np.zeros(len(data) + 1, np.uint64), start, np.zeros(2, np.int64), 400)
    assert number[0] != number[1]
