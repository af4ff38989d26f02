import pytest
from helpers import documents, frame, prose, words
from pyspark.sql import functions as F

from firmatlas.llm import mixing


def plain_targets(sizes):
    """Targets by resharing the excess until no source is above three times its words."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    budget, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return {s: float(3 * sizes[s]) for s in names}
        level = (budget - sum(full.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] >= 3 * sizes[s]]
        if not over:
            return {s: float(full[s]) if s in full else level * weight[s] for s in names}
        full |= {s: 3 * sizes[s] for s in over}


def check(spark, rows):
    got = mixing.mixed(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, largest = {}, {}
    for r in rows:
        n = len(words(r[1]))
        sizes[r[3]] = sizes.get(r[3], 0) + n
        largest[r[3]] = max(largest.get(r[3], 0), n)
    targets = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len(words(r.row.text)) and r.source_size == sizes[r.row.source]
        assert r.target == pytest.approx(targets[r.row.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies == r.size * len(r.finish)
        taken[r.row.source] += r.taken
    budget = sum(sizes.values())
    assert sum(taken.values()) <= budget
    for s in sizes:
        # A source is cut between two documents, and what it leaves goes on in order of finish.
        assert targets[s] - largest[s] <= taken[s] <= targets[s] + sum(largest.values())
    return got


def test_shares(spark):
    rows = [(i, prose(i, 5 + i % 60), "en", ["a", "b", "c", "d", None, "é"][min(i % 9, 5)], 0) for i in range(900)]
    first = check(spark, rows)
    assert sorted(map(str, first)) == sorted(map(str, mixing.mixed(frame(spark, rows[::-1]).repartition(7)).collect()))


def test_small_source_is_repeated_three_times(spark):
    rows = [(i, prose(i, 30), "en", "a" if i < 195 else "b", 0) for i in range(200)]
    got = check(spark, rows)
    assert {r.copies for r in got if r.row.source == "b"} == {3}


def test_slices_and_bins_do_not_change_the_mix(spark, monkeypatch):
    rows = [(i, prose(i, 5 + i % 60), "en", "abc"[i % 3], 0) for i in range(500)]
    one = sorted((r.row.doc_id, r.taken) for r in mixing.mixed(frame(spark, rows)).collect())
    monkeypatch.setattr(mixing, "PER_SLICE", 10)
    assert sorted((r.row.doc_id, r.taken) for r in mixing.mixed(frame(spark, rows)).collect()) == one


def test_order_of_the_stream(spark):
    rows = [(i, prose(i, 20), "en", "abc"[i % 3], 0) for i in range(300)]
    got = mixing.stream(frame(spark, rows)).collect()
    # Weights are 1, 2, 3: at any point the sources have been served about in this proportion.
    half = [r.source for r in got[: len(got) // 4]]
    assert half.count("c") / half.count("a") == pytest.approx(3, rel=0.2)
    assert half.count("b") / half.count("a") == pytest.approx(2, rel=0.2)


def test_edge_cases(spark):
    got = check(spark, documents())
    assert all(r.taken == 0 for r in got if not words(r.row.text))
    df = frame(spark, clashing=True)
    assert mixing.mixed(df).select("row.*").columns == df.columns
    assert mixing.mixed(frame(spark, [])).collect() == []
    assert [r.taken for r in mixing.mixed(frame(spark, [(1, None, "en", "a", 0)])).collect()] == [0]


def test_word_count(spark):
    texts = [None, "", " \t\r\n\x0b\x0c", "a", " a b c\x1cd ", "x\ty\nz"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n for r in df.select(mixing.word_count(F.col("text")).alias("n")).collect()] == [len(words(t)) for t in texts]


