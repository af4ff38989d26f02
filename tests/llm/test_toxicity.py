import random

import numpy as np
from helpers import documents, frame, prose

from firmatlas.llm import toxicity


def labelled(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = prose(seed * 10_000 + i, rng.randrange(20, 120)).split(" ")
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randrange(1, 5)):
                term = rng.choice(["vilegrub", "mudlump", "scabrat"]) if i % 2 else "zorgh" + rng.choice("abcdefgh") + rng.choice("rst")
                w.insert(rng.randrange(len(w)), term)
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled(1200)
    truth = dict(labels)
    known = spark.createDataFrame([x for x in labels if x[0] < 800], "doc_id long, toxic int")
    docs = frame(spark, rows, clashing=True)
    model = toxicity.train(docs, known)
    got = toxicity.scored(docs, model)
    assert got.select("row.*").columns == docs.columns
    unseen = [r for r in got.collect() if r.row.doc_id >= 800]
    caught = sum(r.rejected for r in unseen if truth[r.row.doc_id])
    wrong = sum(r.rejected for r in unseen if not truth[r.row.doc_id])
    assert caught >= 0.95 * sum(truth[r.row.doc_id] for r in unseen) and wrong <= 2
    for r in unseen:
        assert 0 <= r.mention <= 1 and 0 <= r.repeated <= 1 and 0 <= r.toxic <= 1


def test_later_models_weigh_earlier_probabilities(spark):
    rows, labels = labelled(600)
    model = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    width = len(model["table"]) + 2
    assert [len(w) for w in model["weights"]] == [width + 1, width + 2, width + 3]
    assert model["weights"][1][width] > 0 and model["weights"][2][width] > 0


def test_out_of_fold_predictions_do_not_see_their_row():
    rng = np.random.default_rng(0)
    n = 400
    # Each row has a term of its own: a model that sees a row knows its label, one that does not can't.
    row = np.arange(n)
    label = (rng.random(n) < 0.5).astype(float)
    features = (row, row.copy(), np.ones(n))
    labels = np.column_stack([label, label])
    models = toxicity.fit_chain(features, n, n, labels, row % toxicity.FOLDS)
    assert abs(models[1][n]) < 0.5


def test_edge_cases(spark):
    rows, labels = labelled(300)
    model = toxicity.train(frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int"))
    got = toxicity.scored(frame(spark), model).collect()
    assert len(got) == len(documents()) and not any(r.rejected for r in got)
    assert toxicity.scored(frame(spark, []), model).collect() == []
    for some in ([], [(1, 0)], [(1, 1), (2, 1)]):
        one = toxicity.train(frame(spark, rows), spark.createDataFrame(some, "doc_id long, toxic int"))
        assert not any(r.rejected for r in toxicity.scored(frame(spark, rows[:9]), one).collect())


def test_the_bound_on_labelled_rows_holds_for_repeated_ids(spark, monkeypatch):
    rows = [(i % 3, f"{prose(i, 30)} {'vilegrub' if i % 3 == 0 else ''}", "en", "s", 0) for i in range(120)]
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    seen = []
    whole = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda features, n, *rest: seen.append(n) or whole(features, n, *rest))
    toxicity.train(frame(spark, rows), labels, max_labelled=90, min_z=0.5)
    assert seen == [90]


def newton(x, y, ridge=0.3):
    """Ridge logistic regression with a free bias (the last column) by Newton's method."""
    w, cost = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    cost[-1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(cost), x.T @ (p - y) + cost * w)
    return w


def test_chain_against_brute_force():
    rng = np.random.default_rng(3)
    n, width = 240, 6
    dense = (rng.random((n, width)) < 0.4).astype(float)
    other = dense * (np.arange(width) < 4)
    base = dense @ rng.normal(size=width)
    labels = np.column_stack([base + rng.normal(size=n) > 0, base + rng.normal(size=n) > 0.5, base + rng.normal(size=n) > 1]).astype(float)
    flipped = np.where(rng.random(labels.shape) < 0.05, 1 - labels, labels)
    fold = np.arange(n) % toxicity.FOLDS

    def sparse(x):
        row, column = np.nonzero(x)
        return row, column, x[row, column]

    apart = [(sparse(dense), labels), (sparse(other), flipped)] * 2
    got = toxicity.fit_chain(sparse(dense), n, width, labels, fold, apart)
    known = np.zeros((n, 0))
    for category in range(3):
        one = np.ones((n, 1))
        x = np.hstack([dense, known, one])
        exact, found = (1 / (1 + np.exp(-x @ w)) for w in (newton(x, labels[:, category]), got[category]))
        assert np.abs(exact - found).max() < 0.005
        unseen = np.zeros(n)
        for part in range(toxicity.FOLDS):
            x, y = ((dense, labels), (other, flipped))[part % 2]
            x, out = np.hstack([x, known, one]), fold == part
            unseen[out] = 1 / (1 + np.exp(-x[out] @ newton(x[~out], y[~out, category])))
        known = np.column_stack([known, unseen])


def test_terms_are_chosen_without_the_fold(spark, monkeypatch):
    rows, labels = labelled(400)
    truth = dict(labels)
    fold = toxicity.K.mix(np.arange(400).astype(np.uint64)) % np.uint64(toxicity.FOLDS)
    # A term that marks the toxic texts of one fold only.
    rows = [(i, t + (" onlyhere" if truth[i] and fold[i] == 2 else ""), *rest) for i, t, *rest in rows]
    seen = {}
    whole = toxicity._chosen
    monkeypatch.setattr(toxicity, "_chosen", lambda *a: seen.setdefault("chosen", whole(*a)))
    toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = [t.encode() for _, t, *_ in rows]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    number, row, _ = toxicity._terms(data, offsets, len(rows))
    held = [set(number[row == i].tolist()) for i in range(len(rows))]
    for place, left in enumerate([None, *range(toxicity.FOLDS)]):
        use = [i for i in range(len(rows)) if left is None or fold[i] != left]
        share = sum(truth[i] for i in use) / len(use)
        want = {}
        for term in set().union(*held):
            n = sum(term in held[i] for i in use)
            if n >= toxicity.MIN_TEXTS:
                z = (sum(truth[i] for i in use if term in held[i]) - share * n) / (share * (1 - share) * n) ** 0.5
                if abs(z) >= toxicity.MIN_Z:
                    want[term] = z
        term, z = seen["chosen"][place]
        assert term.tolist() == sorted(want) and np.allclose(z, [want[t] for t in sorted(want)])
    only, _, _ = toxicity._terms(np.frombuffer(b"onlyhere", np.uint8), np.array([0, 8]), 1)
    assert only[0] in seen["chosen"][0][0] and only[0] not in seen["chosen"][3][0]
