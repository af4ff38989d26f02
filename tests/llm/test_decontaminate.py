from helpers import ALNUM, documents, frame, prose, words

from firmatlas.llm import decontaminate


def items():
    rows = [(i, prose(500 + i, [5, 10, 14, 30][i % 4])) for i in range(12)]
    return [*rows, rows[2], (50, None), (51, "!!"), (None, prose(700, 20)), (52, "one"), (53, rows[1][1])]


def rows():
    docs = [r[:2] for r in documents()]
    bench = [t for _, t in items() if t]
    docs += [(100 + i, f"{prose(i, 20)} {bench[i % len(bench)].upper()}! {prose(i + 30, 9)}") for i in range(30)]
    return docs + [(200, " ".join(bench)), (201, bench[2] + "\n" + bench[2])]


def plain(docs, bench, size=10):
    grams = {}
    for item, text in bench:
        w = words(text, ALNUM, lower=True)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + size]), set()).update([] if item is None else [str(item)])
    out = []
    for doc_id, text in docs:
        w = words(text, ALNUM, lower=True)
        hit, found = set(), set()
        for length in {len(g) for g in grams}:
            for i in range(len(w) - length + 1):
                if tuple(w[i : i + length]) in grams:
                    hit.update(range(i, i + length))
                    found |= grams[tuple(w[i : i + length])]
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def check(spark, docs, bench, **options):
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in docs])
    got = decontaminate.scan(df, spark.createDataFrame(bench, "item_id long, text string"), **options).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == plain(docs, bench)
    return got


def test_hits(spark):
    check(spark, rows(), items())


def test_several_sets_of_windows(spark):
    got = check(spark, rows(), items(), max_windows=25)
    one = decontaminate.scan(frame(spark, [(i, t, "en", "s", 0) for i, t in rows()]), spark.createDataFrame(items(), "item_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, one))


def test_spans_and_documents(spark):
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in rows()], clashing=True)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    kept = decontaminate.cleaned(df, bench)
    assert kept.columns == df.columns
    hit = {i for i, _, n, _ in plain(rows(), items()) if n}
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows()} - hit
    cut = decontaminate.cleaned(df, bench, mode="spans").collect()
    assert len(cut) == len(rows())
    for r in cut:
        if r.doc_id not in hit and r.doc_id is not None:
            assert r.text in [t for i, t in rows() if i == r.doc_id]
    spans = {r.doc_id: r for r in decontaminate.scan(df, bench).collect()}
    for r in cut:
        if r.doc_id in hit and r.doc_id >= 100:
            text = dict(rows())[r.doc_id].encode()
            keep, at = [], 0
            for s in spans[r.doc_id].spans:
                keep.append(text[at : s.start])
                at = s.end
            assert r.text == (b"".join(keep) + text[at:]).decode()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(frame(spark, []), none).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.scan(frame(spark), none).collect())


def test_a_window_of_very_many_items(spark):
    common, own = prose(900, 10), prose(901, 12)
    bench = [(i, common) for i in range(100_000)] + [(100_000, own)]
    docs = [(i, f"{prose(i, 30)} {common} {prose(i + 50, 9)}" if i % 3 else prose(i, 40)) for i in range(30)] + [(40, own), (41, f"{own} {common}")]
    got = decontaminate.scan(frame(spark, [(i, t, "en", "s", 0) for i, t in docs]), spark.createDataFrame(bench, "item_id long, text string")).collect()
    held = {r.doc_id: r["items"] for r in got}
    every = sorted(map(str, range(100_000)))
    assert len(got) == len(docs)
    for i, _ in docs[:30]:
        assert held[i] == (every if i % 3 else [])
    assert held[40] == ["100000"] and held[41] == sorted([*every, "100000"])
    grams, _ = decontaminate.windows(spark.createDataFrame(bench, "item_id long, text string"), 10)
    assert grams.count() == 4


def test_long_words(spark):
    word = "x" * 3_000_000
    check(spark, [(1, f"{word} {prose(1, 9)} tail"), (2, f"{word}y {prose(1, 9)}")], [(1, f"{word} {prose(1, 9)}")])
    check(spark, [(1, f"{word} {prose(1, 9)} tail"), (2, f"{word}y {prose(1, 9)}")], [(1, f"{word} {prose(1, 9)}"), (2, prose(1, 9))], max_windows=1)
