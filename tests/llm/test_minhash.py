import numpy as np
import pytest
from helpers import components, documents, edited, frame, prose, shingles

from firmatlas.llm import kernel as K
from firmatlas.llm import minhash
from firmatlas.llm.components import components as star_components


def check(spark, rows, size=4, percent=80):
    got = minhash.near_duplicates(frame(spark, [(i, t, "en", "s", 0) for i, t in rows]), size, percent).collect()
    label = components(rows, size, percent)
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted((i, len(shingles(t, size))) for i, t in rows if i is not None)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else label[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == label[r.doc_id])


def test_edge_cases(spark):
    check(spark, [r[:2] for r in documents()])


def test_group_of_near_copies(spark):
    base = prose(5, 150)
    rows = [(i, edited(base, i, [0.0, 0.01, 0.02, 0.03, 0.05, 0.08][i % 6])) for i in range(120)]
    check(spark, rows)
    check(spark, rows, size=5)


def test_chain_is_one_component(spark):
    words = prose(6, 220).split(" ")
    check(spark, [(i, " ".join(words[4 * i : 4 * i + 120])) for i in range(20)])


def test_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_extra_columns_are_not_read(spark):
    plain = minhash.near_duplicates(frame(spark)).orderBy("doc_id", "n_shingles").collect()
    assert minhash.near_duplicates(frame(spark, clashing=True)).orderBy("doc_id", "n_shingles").collect() == plain


@pytest.mark.parametrize("share", [0.5, 0.8, 0.9])
def test_estimate_is_near_the_truth(share):
    rng = np.random.default_rng(3)
    found = []
    for _ in range(60):
        n = 4000
        both = rng.integers(0, 2**64, int(n * share), dtype=np.uint64)
        one, two = (np.sort(np.concatenate([both, rng.integers(0, 2**64, n - len(both), dtype=np.uint64)])) for _ in range(2))
        a, b = (minhash.sketch(x, np.zeros(len(x), np.int64), 1) for x in (one, two))
        found.append(minhash.estimate(a, b, np.array([n]), np.array([n]))[0])
    truth = int(4000 * share) / (2 * 4000 - int(4000 * share))
    assert abs(np.mean(found) - truth) < 0.03


def test_chance_agreement_is_subtracted():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.integers(0, 2**64, 5000, dtype=np.uint64)) for _ in range(60)]
    rows = np.concatenate([np.full(5000, i) for i in range(60)])
    registers = minhash.sketch(np.concatenate(sets), rows, 60)
    same = (registers[:30] == registers[30:]).mean()
    expected = minhash.chance(np.array([5000]), np.array([5000]))[0]
    assert same < 10 * expected + 0.002 and 1e-5 < expected < 1e-2


def test_components_by_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (50, 51)]
    got = {r.node: r.component for r in star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, 50: 50, 51: 50}


def test_long_words_that_collide_in_running_sums_are_told_apart(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((a + b).encode(), np.uint8)
    ends = np.array([0, 4096]), np.array([4096, 8192])
    sums, words = K.span_hash(K.running(data), *ends), K.word_hash(data, *ends)
    assert sums[0] == sums[1] and words[0] != words[1]
    got = minhash.near_duplicates(frame(spark, [(1, a, "en", "s", 0), (2, b, "en", "s", 0), (3, b, "en", "s", 0)]), size=4, percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 2)]
