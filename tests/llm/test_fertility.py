import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import documents, frame, prose, words

from firmatlas.llm import fertility

pytestmark = pytest.mark.skipif(not os.path.isdir(fertility.FOLDER), reason="vocabulary files are not there")


def plain(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


def test_base_counts(spark):
    rows = [*documents(), (300, "\n".join(["a b", "", "a b", " ", "a b "] * 3), None, "s", 0), (301, "# * $ % & | < > 10% é𝄞", "en", "s", 0)]
    got = fertility.measured(frame(spark, rows)).collect()
    counts = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    expected = [(str(r[0]), *plain(r[1])) for r in rows]
    assert counts == sorted((*e, e[1] < 20 or 100 * e[5] > 30 * e[1]) for e in expected)


def test_token_measures():
    encoder = fertility.Encoder(fertility.FOLDER)
    text = prose(3, 300) + " ☃ 𝄞𝄞"
    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc_id": [1], "lang": ["en"], "text": [text]})
    row = next(iter(fertility._measure(fertility.FOLDER)(batch)))
    w = words(text)
    tokens = [t for x in w for t in encoder.bpe.encode_ordinary(" " + x)]
    pieces = [p for x in w for p in encoder.pieces.encode(x)]
    share = np.array(list(Counter(tokens).values())) / len(tokens)
    assert row[8][0] == len(tokens)
    assert row[9][0] == pytest.approx(sum(map(len, w)) / len(tokens))
    assert row[10][0] == pytest.approx(sum(encoder.pieces.is_byte(p) for p in pieces) / len(pieces))
    assert row[11][0] == pytest.approx(-(share * np.log2(share)).sum() / np.log2(len(tokens)))


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(fertility, "CACHE_WORDS", 10)
    encoder = fertility.Encoder(fertility.FOLDER)
    for i in range(20):
        asked = [f"w{i}{j}\u00a0é".encode() for j in range(8)]
        for w, at in zip(asked, encoder.words(asked)):
            assert encoder.flat[encoder.ends[at] : encoder.ends[at + 1]].tolist() == encoder.bpe.encode_ordinary(" " + w.decode())
        assert len(encoder.known) <= 10


def test_bands_reject_what_the_vocabulary_does_not_fit(spark):
    good = [(i, prose(i, 200), ["en", None][i % 2], "s", 0) for i in range(300)]
    odd = [(1000 + i, "".join(chr(0x1D100 + (i * 7 + j) % 90) + " " * (j % 5 == 4) for j in range(400)), "en", "s", 0) for i in range(5)]
    got = {r.doc_id: r for r in fertility.judged(frame(spark, good + odd)).collect()}
    assert not any(got[1000 + i].kept for i in range(5))
    assert sum(got[i].kept for i in range(300)) >= 297


def test_small_groups_are_judged(spark):
    good = [(i, prose(i, 200), "en", "s", 0) for i in range(150)]
    rare = [(500 + i, prose(500 + i, 200), "yy", "s", 0) for i in range(8)]
    rng = random.Random(1)
    odd = [(1000 + i, "".join(chr(0x1D100 + rng.randrange(90)) + " " * (j % 5 == 4) for j in range(400)), ["xx", "yy", None][i % 3], "s", 0) for i in range(9)]
    got = {r.doc_id: r for r in fertility.judged(frame(spark, good + rare + odd)).collect()}
    assert not any(got[1000 + i].base_failed or got[1000 + i].kept for i in range(9))
    assert all(got[500 + i].kept for i in range(8))


def test_bands_do_not_switch_at_a_number_of_texts(spark):
    def low(n):
        rows = [(i, lang, "latin", 0, 0, 0, 0, 0, 200, value, 0.0, 0.9, False) for lang, k, value in (("en", 400, 4.0), ("es", n, 2.0)) for i in range(k)]
        schema = "doc_id long, lang string, script string, " + ", ".join([*(f"{c} long" for c in fertility.COLUMNS), *(f"{c} double" for c in fertility.MEASURES), "base_failed boolean"])
        return {r.group: r.chars_per_token_low for r in fertility.bands(spark.createDataFrame(rows, schema)).collect()}["es"]

    few, just_below, just_above, many = map(low, (3, 99, 101, 390))
    assert few > just_below > just_above > many and just_below - just_above < 0.05


def test_edge_cases(spark):
    got = fertility.judged(frame(spark, clashing=True)).collect()
    assert len(got) == len(documents()) and all(r.kept is not None for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    assert fertility.judged(frame(spark, [])).collect() == []


def test_copies_of_the_task_function_share_one_encoder():
    """Spark unpickles a task's function anew, which must not load the vocabularies again."""
    from pyspark import cloudpickle

    a, b = (cloudpickle.loads(cloudpickle.dumps(fertility.encoder)) for _ in range(2))
    tool = a(fertility.FOLDER)
    tool.words([b"once"])
    assert b(fertility.FOLDER) is tool and b"once" in b(fertility.FOLDER).known
