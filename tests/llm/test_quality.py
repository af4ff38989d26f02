import random

import numpy as np
from helpers import documents, frame, prose

from firmatlas.llm import quality


def labelled(n):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        text, bad = prose(i, rng.randrange(30, 200)), i % 5 == 0
        if bad:
            text = [text.upper(), text.replace(" ", "### "), " | ".join(text.split(" ")), " ".join(w for w in text.split(" ")[:9] for _ in range(12))][i // 5 % 4]
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled(1000)
    measured = quality.measured(frame(spark, rows))
    model = quality.train(measured, spark.createDataFrame(labels[:600], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.scored(measured, model).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, y in labels[600:]]
    assert np.mean(right) > 0.95


def test_model_is_the_shrunk_covariance(spark):
    rows, labels = labelled(200)
    measured = quality.measured(frame(spark, rows))
    model = quality.train(measured, spark.createDataFrame(labels, "doc_id long, quality int"))
    x = {r.doc_id: np.array(r.x) for r in measured.collect()}
    parts = {k: np.array([x[i] for i, y in labels if y == k]) for k in (0, 1)}
    pooled = sum(len(p) / 200 * np.cov(p.T, bias=True) for p in parts.values())
    for k, p in parts.items():
        cov = (1 - quality.POOL) * np.cov(p.T, bias=True) + quality.POOL * pooled
        cov = (1 - quality.RIDGE) * cov + (quality.RIDGE * np.trace(cov) / len(cov) + 1e-9) * np.eye(len(cov))
        share, mean, factor = model["classes"][k]
        assert np.allclose(mean, p.mean(axis=0)) and np.allclose(factor @ factor.T, cov) and np.isclose(share, np.log(len(p) / 200))
        gap = p[0] - mean
        expected = share - 0.5 * gap @ np.linalg.solve(cov, gap) - 0.5 * np.linalg.slogdet(cov)[1]
        assert np.isclose(quality.log_density(p[:1], model["classes"][k])[0], expected)


def test_edge_cases(spark):
    measured = quality.measured(frame(spark, clashing=True))
    labels = [(i, i % 2) for i in range(20)] + [(None, 1), (3, None), (4, 7), (9999, 0), (2, 0)]
    model = quality.train(measured, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.scored(measured, model).collect()
    assert len(got) == len(documents()) and all(0 <= r.score <= 1 for r in got)
    for some, score in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)):
        one = quality.train(measured, spark.createDataFrame(some, "doc_id long, quality int"))
        assert {r.score for r in quality.scored(measured, one).collect()} == {score}
    assert quality.scored(quality.measured(frame(spark, [])), model).collect() == []
