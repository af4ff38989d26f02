"""Small documents for the tests, and plain counterparts of the operators."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns with names that the operators use themselves.
CLASHING = ", row string, n long, band long, kept boolean, hash long, size long, taken long, words string, spans string, label int, text_key long"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = [rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + rng.choice("lmnrst") + str(i % 7) * (i % 3 == 0) + "é" * (i % 11 == 0) for i in range(vocabulary)]
    out = []
    for i in range(n):
        out.append(rng.choice(words) + ("." if i % 12 == 11 else ""))
    return " ".join(out)


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def documents():
    """Rows with copies, near copies, shared passages, and the cases that every operator must take."""
    base = [prose(i, 60 + 40 * (i % 5)) for i in range(12)]
    passage = prose(900, 90)
    texts = list(base)
    texts += [base[0], base[0], base[1] + " end", edited(base[2], 1, 0.02), edited(base[2], 2, 0.03), edited(base[3], 3, 0.3)]
    texts += [f"{prose(50 + i, 30)}\n{passage}\n{prose(70 + i, 25)}" for i in range(5)]
    texts += ["", None, "one", "one", "a b c d", "  \n\t \n", "Ünï cödé ☃ 𝄞 " * 40, "la la " * 300, prose(77, 4000)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s1"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    # A repeated row, a repeated id with another text, and rows without id.
    return [*rows, rows[4], (5, base[6] + " more", "en", "s2", 9), (None, base[7], "en", "s3", 1), (None, None, None, None, None)]


def frame(spark, rows=None, clashing=False):
    rows = documents() if rows is None else rows
    schema = DOCUMENTS
    if clashing:
        schema += CLASHING
        rows = [(*r, "r", 1, 2, True, 3, 4, 5, "w", "s", 1, 7) for r in rows]
    return spark.createDataFrame(rows, schema)


def words(text, pattern=WORD, lower=False):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def shingles(text, size):
    w = words(text, lower=True)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)}


def components(rows, size, percent):
    """Smallest reachable doc_id by comparing all pairs; rows of one doc_id are one node."""
    nodes = {}
    for doc_id, text in rows:
        if doc_id is not None:
            nodes.setdefault(doc_id, []).append(shingles(text, size))
    label = {n: n for n in nodes}
    changed = True
    links = []
    ids = sorted(nodes)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in nodes[a]:
                for y in nodes[b]:
                    both = len(x & y)
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        links.append((a, b))
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label
