import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from helpers import documents, frame, prose

from firmatlas.llm import alignment, worker

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def tools():
    a = tokenizers.Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECES}")


def tokens(tools, text):
    """(id, start, end) of A and of B by the plain libraries, or nothing."""
    a, b = tools
    if not text:
        return [], []
    table = alignment.byte_level()
    left = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
        return [], []

    def placed(pieces):
        at, out = 0, []
        for i, piece in pieces:
            out.append((i, at, at + len(piece)))
            at += len(piece)
        return out

    return placed(left), placed(right)


def brute(tools, rows):
    parts, counts = [], Counter()
    for doc_id, text, *_ in rows:
        a, b = tokens(tools, text)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, s, e in a if start <= s < cut) + "|" + ",".join(str(i) for i, s, e in b if start <= s < cut))
            start = cut
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        counts.update(links)
        parts.append((doc_id, len(a), len(b), groups, links))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for doc_id, n_a, n_b, groups, links in parts:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["<|endoftext|> <s> </s> <unk>", "▁ a▁b", "a\x00b\tc\n\n d", "ﬁ Å é ü", "日本語 текст 🙂🙂 עברית", " leading  double   spaces ", "\u00a0\u2003x", "'s don't I'll", " ", "\n", "\r\n" * 9]


def test_documents_match_brute_force(spark, tools):
    rows = [r for r in documents() if len(r[1] or "") < 3000]
    rows += [(1000 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    got = alignment.alignments(frame(spark, rows, clashing=True)).select(*COLUMNS).collect()
    want = brute(tools, rows)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert any(r[1] == 0 and r[0] is not None and r[0] >= 1000 for r in want) and any(r[0] is None for r in want)


def test_pairs_come_from_all_chunks(spark, tools, monkeypatch):
    rows = [(i, prose(i % 7, 40), "en", "s", 1) for i in range(40)]
    monkeypatch.setattr(alignment, "CHUNK", 700)
    monkeypatch.setattr(alignment, "STEP", 300)
    docs = frame(spark, rows).repartition(3)
    got = alignment.alignments(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(tools, rows)
    pairs = {(r["a"], r["b"]): (r["total"], r["best"]) for r in alignment.links(docs).collect()}
    assert sum(n for n, _ in pairs.values()) == sum(r["n_links"] for r in got)


def test_long_texts(spark, tools):
    # Runs of white space and of one word that recursive matching does not survive.
    rows = [(1, "x" + " " * 3_000_000 + "y", "en", "s", 1), (2, "ab" * 500_000, "en", "s", 1), (3, prose(5, 150_000), "en", "s", 1)]
    got = {r["doc_id"]: r for r in alignment.alignments(frame(spark, rows)).collect()}
    for doc_id, text, *_ in rows:
        a, b = tokens(tools, text)
        both = len({e for *_, e in a} & {e for *_, e in b})
        assert (got[doc_id]["n_a"], got[doc_id]["n_b"], got[doc_id]["n_groups"]) == (len(a), len(b), both)
        assert got[doc_id]["n_links"] == len(a) + len(b) - both


def test_empty(spark):
    assert alignment.alignments(frame(spark, [])).collect() == []
    got = alignment.alignments(frame(spark, [(1, None, None, None, None), (2, "", "en", "s", 0)])).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "")}


def test_groups_of_any_intervals():
    starts, ends = np.array([0, 4, 2, 9, 5]), np.array([3, 5, 4, 10, 9])
    order, group = alignment.groups(starts, ends)
    assert starts[order].tolist() == [0, 2, 4, 5, 9] and group.tolist() == [0, 0, 1, 2, 3]


def test_decimals():
    ids = np.array([0, 9, 10, 99, 100, 50_255, 999_999])
    cells, n = alignment.decimals(ids)
    assert [bytes(c[:k]).decode() for c, k in zip(cells, n)] == [str(i) for i in ids]


def test_copies_of_a_function_share_what_the_process_keeps():
    a, b = (cloudpickle.loads(cloudpickle.dumps(worker.kept)) for _ in range(2))
    assert a(("test",), list) is b(("test",), list)
