import hashlib
import zlib

from helpers import LOWER, documents, frame

from firmatlas.llm import merkle
from pyspark.sql import functions as F


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h("".join(map(field, (doc_id, source, lang, n_chars, text))))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, index):
    out = []
    for level in tree[:-1]:
        first = index // 8 * 8
        out.append((level[first:index], level[index + 1 : first + 8]))
        index //= 8
    return out


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root) of the whole manifest, by hand."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            doc_id, text, *rest = row
            changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            node = leaf((doc_id, text and text.translate(LOWER) if changed else text, *rest))
            steps = siblings(trees[g], i) + siblings(top, k)
            proof = h("".join("".join(a + b) for a, b in steps))
            for before, after in steps:
                node = h("".join(before) + node + "".join(after))
            out.append((doc_id, leaf(row), trees[g][-1][0], top[-1][0], proof, node))
    return sorted(out, key=repr)


def found(docs):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.leaf([lowered if c == "text" else F.col(c) for c in merkle.FIELDS])
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, tampered)
    return merkle.manifest(docs, changed, copies=True)


def plain(rows):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in rows), key=repr)


def test_awkward_rows_match_brute_force(spark):
    rows = documents()
    got = found(frame(spark, rows, clashing=True)).collect()
    assert plain(got) == brute(rows)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)


def test_several_tiers_match_brute_force(spark):
    # More than BLOCK rows in one group, and groups of one, of 8, of 9 and of exactly a block.
    sizes = {"en": 1100, None: 1, "": 8, "fr": 9, "é": 512, "z": 513}
    rows, at = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((at, f"Text {at % 50} A", lang, "s", at))
            at += 1
    got = found(frame(spark, rows[::-1])).collect()
    assert plain(got) == brute(rows)


def test_versions_share_all_but_the_ancestors(spark):
    rows = [(i, f"Text {i} A", "en", "s", i) for i in range(600)]
    got = found(frame(spark, rows)).collect()
    tree = levels([leaf(r) for r in rows])
    for r in got:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        assert (r["copied"] is not None) == changed and r["verified"] != changed
        if changed:
            # A copy for each level, and none of them in the first version.
            assert len(r["copied"]) == len(tree) and r["copied"][-1] == r["folded_root"]
            assert not any(node in level for node, level in zip(r["copied"], tree))


def test_nothing_changed_and_equal_rows(spark):
    rows = [(1, "a b", "en", "s", 3)] * 1200
    got = merkle.manifest(frame(spark, rows)).collect()
    assert len(got) == 1200 and all(r["verified"] for r in got) and len({r["proof_sha256"] for r in got}) > 1


def test_empty_and_single(spark):
    assert found(frame(spark, [])).collect() == []
    one = [(1, None, None, None, None)]
    assert plain(found(frame(spark, one)).collect()) == brute(one)
    assert brute(one)[0][1] == brute(one)[0][3]
