"""Document quality by a regularised quadratic discriminant.

Every text is reduced to transformed statistics: logarithms of counts and lengths, arcsines of shares.
Each class of labelled texts gets a mean and a covariance over them. The covariance is shrunk: a part
``pool`` of it is the covariance over both classes, and a part ``ridge`` of the result is a multiple of
the identity with the same trace. Its Cholesky factor is kept, and the score is the logistic of the
difference of the two log densities (half the Mahalanobis distances and the factors' log diagonals) and
of the log shares of the classes.

Means and covariances come from sums over all labelled rows, added up in tasks; only the sums, whose size
depends on the number of statistics, reach the driver. Texts are read once; a table of their statistics
serves both training and scoring.

Defined cases: null and empty texts have statistics of their own (all counts 0) and get a score; null
labels are not used; a doc_id that is labelled twice counts twice; rows that repeat a doc_id are scored
each by its own text; without labels the score is 0.5, with labels of one class it is 1 or 0 for all; an
empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmatlas.llm import kernel as K
from firmatlas.llm.store import written

STATISTICS = (
    "words", "chars_per_word", "word_spread", "lines", "words_per_line", "upper", "digits", "symbols", "pipes", "marks",
    "other_marks", "beyond_ascii", "short_words", "same_as_last", "distinct", "distinct_lines", "longest_word", "sentences",
)
POOL, RIDGE = 0.1, 0.02


def _class(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


UPPER, DIGIT, SYMBOL, PIPE, MARK = (_class(c) for c in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>=_~^@+\\", "|", "!?"))
OTHER, STOP = _class(",;:()[]{}\"'/-`"), _class(".!?")
BEYOND = np.arange(256) >= 128


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def statistics(data, offsets, rows: int) -> np.ndarray:
    """The transformed statistics of a chunk, one row per text."""
    size = np.diff(offsets)

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    start, end, row = K.words(data, offsets, ~K.SPACE)
    length = (end - start).astype(np.float64)
    n = np.bincount(row, minlength=rows)
    mean = np.bincount(row, weights=length, minlength=rows) / np.maximum(n, 1)
    spread = np.bincount(row, weights=length**2, minlength=rows) / np.maximum(n, 1) - mean**2
    hashes = K.word_hash(K.LOWER[data], start, end)
    same = np.zeros(len(row), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)

    def distinct(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[new], minlength=rows)

    newline = np.ones(256, bool)
    newline[10] = False
    first, last, line_row = K.words(data, offsets, newline)
    n_lines = np.bincount(line_row, minlength=rows)
    line_hashes = K.word_hash(data, first, last)
    columns = [
        np.log1p(n), np.log1p(mean), np.log1p(np.sqrt(np.maximum(spread, 0))), np.log1p(n_lines), np.log1p(n / np.maximum(n_lines, 1)),
        _share(count(UPPER), size), _share(count(DIGIT), size), _share(count(SYMBOL), size), _share(count(PIPE), size), _share(count(MARK), size),
        _share(count(OTHER), size), _share(count(BEYOND), size), _share(np.bincount(row, weights=length <= 3, minlength=rows), n),
        _share(np.bincount(row, weights=same, minlength=rows), n), _share(distinct(hashes, row), n),
        _share(distinct(line_hashes, line_row), n_lines), np.log1p(longest), _share(count(STOP), n),
    ]
    return np.column_stack(columns)


def _measured(batch):
    for first, stop, data, offsets in K.texts(batch.column("text")):
        rows = stop - first
        values = statistics(data, offsets, rows)
        yield [batch.column("doc_id").slice(first, rows), K.lists(values.ravel(), np.full(rows, values.shape[1]))]


MEASURED = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])


def _sums(batches):
    """Per class of a partition: number of rows, sum of x and sum of outer products."""
    d = len(STATISTICS)
    held = {k: [0, np.zeros(d), np.zeros((d, d))] for k in (0, 1)}
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, d)
        label = batch.column("label").to_numpy()
        for k, parts in held.items():
            own = x[label == k]
            parts[0] += len(own)
            parts[1] += own.sum(axis=0)
            parts[2] += own.T @ own
    for k, (n, s, ss) in held.items():
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n]), pa.array([s]), pa.array([ss.ravel()])], names=["label", "n", "s", "ss"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the array x of statistics of every row, written once."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.batches(_measured, MEASURED), "doc_id long, x array<double>")
    return written(rows, "statistics")


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", pool: float = POOL, ridge: float = RIDGE) -> dict:
    """Class shares, means and Cholesky factors from the statistics of the labelled rows."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    sums = rows.join(labels, "doc_id").select("label", "x").mapInArrow(_sums, "label int, n long, s array<double>, ss array<double>")
    d = len(STATISTICS)
    cells = sums.select("label", "n", F.posexplode(F.concat("s", "ss")).alias("at", "value"))
    cells = cells.groupBy("label", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).toArrow().to_pydict()
    model: dict = {"classes": {}}
    flat = {}
    for k, at, n, value in zip(cells["label"], cells["at"], cells["n"], cells["value"]):
        flat.setdefault(k, [n, np.zeros(d + d * d)])[1][at] = value
    if not flat:
        return model
    everything = sum(n for n, _ in flat.values())
    spread = {}
    for k, (n, values) in flat.items():
        mean = values[:d] / n
        spread[k] = (n, mean, values[d:].reshape(d, d) / n - np.outer(mean, mean))
    pooled = sum(n / everything * s for n, _, s in spread.values())
    for k, (n, mean, own) in spread.items():
        cov = (1 - pool) * own + pool * pooled
        cov = (1 - ridge) * cov + (ridge * np.trace(cov) / d + 1e-9) * np.eye(d)
        model["classes"][k] = (np.log(n / everything), mean, np.linalg.cholesky(cov))
    return model


def log_density(x: np.ndarray, part: tuple) -> np.ndarray:
    share, mean, factor = part
    z = np.linalg.solve(factor, (x - mean).T)
    return share - 0.5 * (z**2).sum(axis=0) - np.log(np.diag(factor)).sum()


def _scores(shared):
    def one(batch):
        classes = shared.value["classes"]
        x = batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS))
        if len(classes) == 2:
            gap = np.clip(log_density(x, classes[1]) - log_density(x, classes[0]), -700, 700)
            score = 1 / (1 + np.exp(-gap))
        else:
            score = np.full(len(x), {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(classes)])
        yield [batch.column("doc_id"), score]

    return K.batches(one, pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]))


def scored(rows: DataFrame, model: dict) -> DataFrame:
    """doc_id and score for every row of ``measured``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scores(shared), "doc_id long, score double")
