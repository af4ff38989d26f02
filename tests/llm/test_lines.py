from collections import Counter

from helpers import documents, frame, prose, words
from pyspark.sql import functions as F

from firmatlas.llm import lines
from firmatlas.llm.membership import bit_table, with_maybe


def plain(rows, least):
    """Deleted line positions per row: runs of ``least`` words that occur earlier, by all windows of lines."""
    split = {}
    for k, (doc_id, text) in enumerate(rows):
        if text is not None:
            own = [(i, tuple(words(x))) for i, x in enumerate(text.split("\n"))]
            split[k] = [(i, w) for i, w in own if w]
    order = sorted(split, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, gone = {}, {k: set() for k in split}
    for k in order:
        ls = split[k]
        for a in range(len(ls)):
            total = 0
            for b in range(a, len(ls)):
                total += len(ls[b][1])
                if total >= least:
                    key = tuple(w for _, w in ls[a : b + 1])
                    if seen.setdefault(key, (k, a)) != (k, a):
                        gone[k].update(i for i, _ in ls[a : b + 1])
    return gone


def check(spark, rows, least=50):
    got = lines.deduplicated(frame(spark, [(i, t, "en", "s", 0) for i, t in rows]), least).collect()
    gone = plain(rows, least)
    expected = sorted(((i, t, sorted(gone.get(k, ()))) for k, (i, t) in enumerate(rows)), key=str)
    assert sorted(((r.row.doc_id, r.row.text, list(r.deleted)) for r in got), key=str) == expected
    for r in got:
        if r.row.text is not None:
            assert r.text == "\n".join(x for i, x in enumerate(r.row.text.split("\n")) if i not in set(r.deleted))


def test_runs_of_short_and_long_lines(spark):
    runs = [[prose(100 * k + i, 8 + i) for i in range(6)] for k in range(4)]
    rows = []
    for i in range(24):
        parts = [prose(1000 + i, 12), *runs[i % 4][i % 3 :], "", prose(2000 + i, 55), *runs[(i + 1) % 4][: 3 + i % 4], "  "]
        rows.append((i, "\n".join(parts)))
    check(spark, rows)
    check(spark, rows, least=20)


def test_edge_cases(spark):
    rows = [r[:2] for r in documents()]
    # Rows that repeat id and text count once, so each shows the same result.
    unique = list(dict.fromkeys(rows))
    check(spark, [r for r in unique if r[0] not in (5, None)])
    assert lines.deduplicated(frame(spark), 50).count() == len(rows)


def test_repeats_within_a_document(spark):
    check(spark, [(1, "\n".join([prose(1, 60)] * 5)), (2, "\n".join(["a b", "c d"] * 60))])


def test_other_columns_stay(spark):
    df = frame(spark, clashing=True)
    got = lines.deduplicated(df, 50).select("row.*")
    assert got.columns == df.columns and got.count() == df.count()


def test_empty_table(spark):
    assert lines.deduplicated(frame(spark, []), 50).collect() == []


def test_only_repeated_fingerprints_go_on(spark):
    """Windows of texts that share nothing stop at the fingerprints, though neighbours choose the same line."""
    shared = "\n".join(prose(800 + i, 9) for i in range(12))
    rows = [(i, "\n".join(prose(40 * i + j, 7) for j in range(30)), "en", "s", 0) for i in range(20)]
    rows += [(100 + i, f"{prose(5000 + i, 60)}\n{shared}\n{prose(6000 + i, 60)}", "en", "s", 0) for i in range(3)]
    docs = lines._documents(frame(spark, rows))
    windows = lines._windows(docs, 50, content=True).count()
    near = lines.repeated_windows(docs, 50).collect()
    counts = Counter((r.k1, r.k2, r.words) for r in near)
    repeated = sum(n for n in counts.values() if n > 1)
    assert windows > 10 * repeated / 3 and repeated <= len(near) <= 2 * repeated
    assert {r.id for r in near} == {100, 101, 102}


def test_texts_that_keep_all_lines_are_not_joined(spark):
    shared = "\n".join(prose(800 + i, 9) for i in range(12))
    rows = [(i, prose(i, 80), "en", "s", 0) for i in range(30)] + [(50, shared, "en", "s", 0), (51, shared, "en", "s", 0)]
    found = frame(spark, rows)
    bits = bit_table(found.filter("doc_id >= 50").select(F.xxhash64("doc_id").alias("key")), "key")
    got = with_maybe(found.withColumn("key", F.xxhash64("doc_id")), "key", bits)
    assert {r.doc_id for r in got.filter("maybe").collect()} == {50, 51}
    assert set(got.columns) == {*found.columns, "key", "maybe"}
