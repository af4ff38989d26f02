"""Toxic documents by a chain of linear classifiers.

The categories are predicted in order: ``mention`` (an abusive term occurs), ``repeated`` (two different
ones do) and ``toxic``, the label. Each model is a logistic regression on the terms of a text and on the
probabilities of the categories before it. In training these come from models fitted without the row
(out-of-fold), so that a later model sees them as unsure as they will be in use. Such a model also chooses
its terms, and derives the first two categories, without the rows of the fold that it is asked about.

Terms are whole words and word beginnings, hashed into ``1 << BITS`` numbers. Those that go together with
the label far beyond chance (``min_z``) are kept, ``max_terms`` at most. A term of the kept ones with a
positive association is an abusive term; the first two categories are derived from them, as the tables
label only the last. Their models thus say which terms the labels name, not more than that.

The models are fitted on at most ``max_labelled`` labelled rows, chosen by a hash of doc_id, where a row
has a text and a label. All texts are scored whole. The sample, the kept terms and the models are the only
things that reach the driver or are broadcast, and each has its bound in a parameter.

Defined cases: null or empty texts have no terms and get the probability of such a text; null labels and
labels of unknown ids are not used; with labels of one class only, or none, no text is rejected and the
probability is the share of toxic labels (0 without labels); rows that repeat a doc_id are scored each by
its own text; an empty table gives an empty result; further columns, whatever their names, are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from firmatlas.llm import kernel as K
from firmatlas.llm.store import scratch, written

BITS = 20
#: Lengths in bytes of the word beginnings that are terms, besides the whole word (0).
BEGINNINGS = (0, 4, 5, 6, 7, 8)
CATEGORIES = ("mention", "repeated", "toxic")
FOLDS = 4
MAX_LABELLED, MAX_TERMS, MIN_Z, MIN_TEXTS = 20_000, 4_096, 5.5, 5


def _terms(data, offsets, rows: int):
    """Term number and row of every word and word beginning, and the number of words by row."""
    data = K.LOWER[data]
    start, end, row = K.words(data, offsets, K.ALNUM)
    prefix = K.running(data)
    numbers, owners = [], []
    for length in BEGINNINGS:
        use = np.flatnonzero(end - start > length) if length else np.arange(len(start))
        stop = start[use] + length if length else end[use]
        hashed = K.mix(K.span_hash(prefix, start[use], stop) + np.uint64(length))
        numbers.append((hashed >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(row[use])
    return np.concatenate(numbers), np.concatenate(owners), np.bincount(row, minlength=rows)


def _training_rows(batch):
    for first, stop, data, offsets in K.texts(batch.column("text")):
        rows = stop - first
        number, row, n_words = _terms(data, offsets, rows)
        pairs, times = np.unique((row << BITS) | number, return_counts=True)
        counts = np.bincount(pairs >> BITS, minlength=rows)
        ids = batch.column("doc_id").slice(first, rows)
        fold = K.mix(ids.to_numpy().view(np.uint64)) % np.uint64(FOLDS)
        yield [
            ids, batch.column("label").slice(first, rows), fold.astype(np.int32), n_words.astype(np.int64),
            K.lists((pairs & ((1 << BITS) - 1)).astype(np.int32), counts), K.lists(times.astype(np.int32), counts),
        ]


TRAINING = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("fold", pa.int32()), ("n_words", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
TRAINED = "doc_id long, label int, fold int, n_words long, terms array<int>, times array<int>"


def _sparse(row: np.ndarray, column: np.ndarray, times: np.ndarray, n_words: np.ndarray, abusive: np.ndarray, width: int):
    """Feature triples: presence of each term, then log count and share of abusive terms."""
    rows = len(n_words)
    hits = np.bincount(row, weights=times * abusive[column], minlength=rows)
    some = np.flatnonzero(hits)
    row = np.concatenate([row, some, some])
    value = np.concatenate([np.ones(len(column)), np.log1p(hits[some]), hits[some] / np.maximum(n_words[some], 1)])
    column = np.concatenate([column, np.full(len(some), width), np.full(len(some), width + 1)])
    return row, column, value


def _fit(features, rows: int, width: int, extra: np.ndarray, label: np.ndarray, use: np.ndarray, steps: int = 300, ridge: float = 0.3):
    """Weights of a ridge logistic regression (terms, extra columns, bias) by accelerated gradient.

    All features are at least 0, so a quarter of each column's sum weighted by row sums bounds the
    curvature and gives every weight a step of its own.
    """
    row, column, value = features
    keep = use[row]
    row, column, value = row[keep], column[keep], value[keep]
    k = extra.shape[1]
    extra, label = np.where(use[:, None], extra, 0.0), np.where(use, label, 0.0)
    heavy = np.where(use, np.bincount(row, weights=value, minlength=rows) + extra.sum(axis=1) + 1, 0.0)
    curve = np.concatenate([np.bincount(column, weights=value * heavy[row], minlength=width), extra.T @ heavy, [heavy.sum()]])
    rate = 1.0 / (0.25 * curve + ridge)
    w, last = np.zeros(width + k + 1), np.zeros(width + k + 1)
    for step in range(steps):
        ahead = w + step / (step + 3) * (w - last)
        z = np.bincount(row, weights=value * ahead[column], minlength=rows) + extra @ ahead[width : width + k] + ahead[-1]
        error = np.where(use, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label, 0.0)
        slope = np.concatenate([np.bincount(column, weights=value * error[row], minlength=width), extra.T @ error, [error.sum()]])
        slope[:-1] += ridge * ahead[:-1]
        last, w = w, ahead - rate * slope
    return w


def _apply(features, rows: int, width: int, extra: np.ndarray, w: np.ndarray) -> np.ndarray:
    row, column, value = features
    z = np.bincount(row, weights=value * w[column], minlength=rows) + extra @ w[width:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(features, rows: int, width: int, labels: np.ndarray, fold: np.ndarray, apart: list | None = None) -> list[np.ndarray]:
    """One weight vector per category (columns of labels); later ones also weigh earlier probabilities.

    ``apart`` holds by fold the features and labels as they are chosen without its rows; where it is not
    given they are the same for all folds.
    """
    models, known = [], np.zeros((rows, 0))
    everyone = np.ones(rows, bool)
    for category in range(labels.shape[1]):
        models.append(_fit(features, rows, width, known, labels[:, category], everyone))
        if category + 1 < labels.shape[1]:
            unseen = np.zeros(rows)
            for part in range(FOLDS):
                some, targets = apart[part] if apart else (features, labels)
                inside = fold == part
                w = _fit(some, rows, width, known, targets[:, category], ~inside)
                unseen[inside] = _apply(some, rows, width, known, w)[inside]
            known = np.column_stack([known, unseen])
    return models


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS, min_z: float = MIN_Z) -> dict:
    """The model: number of each kept term, which of them are abusive, and a weight vector per category."""
    with scratch(docs.sparkSession):
        return _trained(docs, labels, label, max_labelled, max_terms, min_z)


def _trained(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int, max_terms: int, min_z: float) -> dict:
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id").dropna()
    rows = rows.mapInArrow(K.batches(_training_rows, TRAINING), TRAINED)
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "toxic-terms")
    # Repeated doc_ids can make more rows of as many labels.
    some = rows.select("place", "doc_id", "label", "n_words").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "n_words", "place").limit(max_labelled)
    rows = written(rows.join(F.broadcast(some.select("place")), "place", "left_semi").drop("place"), "toxic-rows")
    folds = {r.fold: (r.total, r.positive) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("total"), F.sum("label").alias("positive")).collect()}
    total, positive = (sum(x[i] for x in folds.values()) for i in range(2))
    empty = {"table": np.zeros(0, np.int64), "abusive": np.zeros(0, bool), "weights": [], "share": positive / total if total else 0.0}
    if not 0 < positive < total:
        return empty
    chosen = _chosen(rows, folds, max_terms, min_z)
    term = np.unique(np.concatenate([x for x, _ in chosen]))
    shared = docs.sparkSession.sparkContext.broadcast(term)
    found = rows.mapInArrow(K.batches(_kept_terms(shared), TRAINING), TRAINED).toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("n_words", "ascending")]).combine_chunks()
    whole, *apart = [_view(found, len(term), np.searchsorted(term, x), z > 0) for x, z in chosen]
    width = len(term) + 2
    weights = fit_chain(whole[0], len(found), width, whole[1], found.column("fold").to_numpy(), apart)
    # Terms that only a fold chose have no weight in the models of all rows.
    own, score = chosen[0]
    place = np.concatenate([np.searchsorted(term, own), np.arange(len(term), width)])
    return empty | {"table": own, "abusive": score > 0, "weights": [np.concatenate([w[place], w[width:]]) for w in weights]}


def _chosen(rows: DataFrame, folds: dict, max_terms: int, min_z: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms in order and their z: chosen on all rows, then without each fold's."""
    def of(fold: int, what):
        return F.sum(F.when(F.col("fold") == fold, what).otherwise(0))

    counts = [of(i, F.lit(1)).alias(f"n{i}") for i in range(FOLDS)] + [of(i, F.col("label")).alias(f"pos{i}") for i in range(FOLDS)]
    seen = written(rows.select("label", "fold", F.explode("terms").alias("term")).groupBy("term").agg(*counts), "toxic-counts")
    out = None
    for left in (None, *range(FOLDS)):
        used = [i for i in range(FOLDS) if i != left]
        total, positive = (sum(folds.get(i, (0, 0))[k] for i in used) for k in range(2))
        share = positive / total if 0 < positive < total else None
        n, n_pos = (sum((F.col(f"{name}{i}") for i in used), F.lit(0)) for name in ("n", "pos"))
        # Without both classes nothing is associated with the label.
        z = (n_pos - share * n) / F.sqrt(share * (1 - share) * n) if share else F.lit(0.0)
        some = seen.filter(n >= MIN_TEXTS).select(F.lit(-1 if left is None else left).alias("left"), "term", z.alias("z"))
        some = some.filter((F.abs("z") >= min_z) & (F.lit(share is not None))).orderBy(F.abs("z").desc(), "term").limit(max_terms)
        out = some if out is None else out.union(some)
    out = out.toArrow().sort_by("term").combine_chunks()
    left, term, z = (out.column(c).to_numpy() for c in ("left", "term", "z"))
    return [(term[left == i].astype(np.int64), z[left == i]) for i in (-1, *range(FOLDS))]


def _view(found: pa.Table, width: int, places: np.ndarray, positive: np.ndarray):
    """Features and categories of the training rows by some of the terms, of which ``positive`` are abusive."""
    known, abusive = np.zeros(width, bool), np.zeros(width, bool)
    known[places], abusive[places] = True, positive
    n_words = found.column("n_words").to_numpy()
    row = np.repeat(np.arange(len(found)), pc.list_value_length(found.column("terms")).to_numpy())
    column = pc.list_flatten(found.column("terms")).to_numpy().astype(np.int64)
    times = pc.list_flatten(found.column("times")).to_numpy()
    use = known[column]
    row, column, times = row[use], column[use], times[use]
    different = np.bincount(row, weights=abusive[column], minlength=len(found))
    targets = np.column_stack([different >= 1, different >= 2, found.column("label").to_numpy() > 0]).astype(np.float64)
    return _sparse(row, column, times, n_words, abusive, width), targets


def _kept_terms(shared):
    """Training rows with only the kept terms, as places in the table."""

    def one(batch):
        table = shared.value
        terms, times = batch.column("terms"), batch.column("times")
        count = pc.list_value_length(terms).to_numpy()
        row = np.repeat(np.arange(len(batch)), count)
        number = pc.list_flatten(terms).to_numpy()
        place = np.minimum(np.searchsorted(table, number), len(table) - 1) if len(table) else np.zeros(len(number), np.int64)
        keep = table[place] == number if len(table) else np.zeros(len(number), bool)
        counts = np.bincount(row[keep], minlength=len(batch))
        yield [*(batch.column(c) for c in ("doc_id", "label", "fold", "n_words")), K.lists(place[keep].astype(np.int32), counts), K.lists(pc.list_flatten(times).to_numpy()[keep], counts)]

    return one


def _score(shared):
    def run(source):
        model = shared.value
        table, abusive, weights = model["table"], model["abusive"], model["weights"]
        width = len(table) + 2
        place = np.full(1 << BITS, -1, np.int32)
        place[table] = np.arange(len(table))
        for batch in source:
            for first, stop, data, offsets in K.texts(batch.column("text")):
                rows = stop - first
                out = np.full((rows, len(CATEGORIES)), model["share"])
                if weights:
                    number, row, n_words = _terms(data, offsets, rows)
                    at = place[number]
                    some = at >= 0
                    pairs, times = np.unique(row[some] * width + at[some], return_counts=True)
                    features = _sparse(pairs // width, pairs % width, times, n_words, abusive, len(table))
                    known = np.zeros((rows, 0))
                    for w in weights:
                        known = np.column_stack([known, _apply(features, rows, width, known, w)])
                    out = known
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, rows), *(pa.array(out[:, i]) for i in range(len(CATEGORIES)))], names=["row", *CATEGORIES])

    return run


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """Each row of docs as a struct ``row``, with the probability of each category and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    found = rows.mapInArrow(_score(shared), f"row {docs.schema.simpleString()}, " + ", ".join(f"{c} double" for c in CATEGORIES))
    return found.withColumn("rejected", (F.col(CATEGORIES[-1]) >= 0.5) & F.lit(bool(model["weights"])))
