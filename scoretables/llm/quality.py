"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of the whole text (shares of character classes, word lengths, repeated words and lines) are standardised
and mapped to random Fourier features, which approximate a Gaussian kernel. Every partition of the labelled sample
sums its own normal equations for each of FOLDS parts; the sums of all parts give the ridge weights, the sums without
a part give that part's out-of-fold scores, and pooling adjacent violators over those gives the calibration.

The model learns from at most about FIT labelled rows, a bound; everything is scored. Defined results: null texts are
scored like empty ones; rows without a label, and labels without a document, teach nothing; of several labels of a
document the largest counts; with no labels at all every score is 0.5, with labels of one kind only it is that label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretables.llm import tables, text

FEATURES, FOLDS, RIDGE, SEED = 256, 5, 1.0, 11
#: Labelled rows, at most about, that the model learns from.
FIT = 20_000
_NEWLINE = ~text.byte_class((0x0A, 0x0A))
# Character classes by byte: other control, blank, line feed, digit, upper, lower, not ASCII, and single marks.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.zeros(256, np.int64)
_CLASS[0x20], _CLASS[0x0A], _CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:] = 1, 2, 3, 4, 5, 6
for _i, _c in enumerate(_MARKS):
    _CLASS[_c] = 7 + _i
_CLASSES = 7 + len(_MARKS)


def _repeats(words: text.Words) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of distinct words and the largest count of one."""
    n = len(words.bounds) - 1
    distinct, most = np.zeros(n), np.zeros(n)
    if len(words.starts):
        rows, hashes = words.rows(), words.hashes()
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])]))
        counts = np.diff(np.append(first, len(rows)))
        distinct = np.bincount(rows[first], minlength=n).astype(float)
        np.maximum.at(most, rows[first], counts)
    return distinct, most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    words, lines = text.Words(column, text.NON_SPACE, lower=False), text.Words(column, _NEWLINE, lower=False)
    n = len(column)
    size = np.diff(words.offsets)
    total = np.maximum(size, 1)
    rows = np.repeat(np.arange(n), size)
    shares = np.bincount(rows * _CLASSES + _CLASS[words.data], minlength=n * _CLASSES).reshape(n, _CLASSES) / total[:, None]
    n_words, n_lines = np.diff(words.bounds), np.diff(lines.bounds)
    length = words.ends - words.starts
    per_word = np.maximum(n_words, 1)
    mean = np.bincount(words.rows(), length, minlength=n) / per_word
    spread = np.sqrt(np.maximum(np.bincount(words.rows(), length.astype(float) ** 2, minlength=n) / per_word - mean**2, 0))
    distinct, most = _repeats(words)
    own_lines, most_lines = _repeats(lines)
    tail = words.data[np.maximum(words.ends - 1, 0)] if len(words.ends) else words.data[:0]
    marked = np.bincount(words.rows(), (_CLASS[tail] >= 7), minlength=n) / per_word
    extra = np.stack([np.log1p(size), np.log1p(n_words), np.log1p(n_lines), mean, spread, distinct / per_word, most / per_word, own_lines / np.maximum(n_lines, 1), most_lines / np.maximum(n_lines, 1), np.log1p(n_words / np.maximum(n_lines, 1)), marked], axis=1)
    return np.concatenate([np.sqrt(shares), extra], axis=1)


WIDTH = _CLASSES + 11


class Fourier:
    """Standardisation and fixed random Fourier features, with a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        rng = np.random.default_rng(SEED)
        self.turn, self.shift = rng.normal(size=(WIDTH, FEATURES)) / np.sqrt(WIDTH), rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(x @ self.turn + self.shift), np.ones((len(x), 1))], axis=1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean score and mean label of each pool of adjacent violators; to be interpolated."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, y in zip(score[order].tolist(), label[order].tolist(), strict=True):
        pools.append([s, y, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    x, y, n = np.array(pools).T
    return x / n, y / n


class Model:
    def __init__(self, fourier: Fourier | None, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
        self.fourier, self.weights, self.knots = fourier, weights, knots

    def score(self, column: pa.Array) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(column), self.knots[1][0])
        return np.clip(np.interp(self.fourier(statistics(column)) @ self.weights, *self.knots), 0.0, 1.0)


def _solved(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.linalg.solve(gram + RIDGE * np.eye(len(gram)), right)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit: int) -> DataFrame:
    """``key``, ``body`` and label ``y`` of about ``fit`` documents at most: a hash sample of the labels, broadcast."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).cast("double").alias("y"))
    sample = tables.bounded_sample(known, [F.col("key")], fit)
    # About `fit` rows of two numbers, so small enough to broadcast at any size of the input.
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body")).join(F.broadcast(sample), "key")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = FIT) -> Model:
    """``docs`` and ``labels`` hold only rows to learn from."""

    def stats():
        return lambda batch: {"key": batch.column("key"), "y": batch.column("y"), "x": pa.array(list(statistics(batch.column("body"))), pa.list_(pa.float64()))}

    rows = labelled(docs, labels, id_col, text_col, label_col, bound).select("key", "y", "body")
    rows = tables.scratch(tables.map_text(rows, f"key {rows.schema['key'].dataType.simpleString()}, y double, x array<double>", stats, "body"), "statistics")
    summary = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y")).first()
    if not summary.n or summary.y in (0.0, 1.0):
        return Model(None, np.zeros(0), (np.zeros(1), np.array([0.5 if not summary.n else summary.y])))
    spread = rows.select([F.col("x")[i].alias(f"x{i}") for i in range(WIDTH)]).agg(*(f(f"x{i}") for f in (F.avg, F.stddev_pop) for i in range(WIDTH))).first()
    fourier = Fourier(np.array(spread[:WIDTH]), np.array(spread[WIDTH:]))
    part = F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int")

    def features(batch):
        x = np.array(batch.column("x").to_pylist(), float).reshape(-1, WIDTH)
        return fourier(x), batch.column("y").to_numpy(), batch.column("part").to_numpy()

    def sums(batches):
        size = FEATURES + 1
        gram, right = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for batch in batches:
            z, y, own = features(batch)
            for k in range(FOLDS):
                gram[k] += z[own == k].T @ z[own == k]
                right[k] += y[own == k] @ z[own == k]
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS), pa.int32()), pa.array([g.tobytes() for g in gram], pa.binary()), pa.array([r.tobytes() for r in right], pa.binary())], names=["part", "gram", "right"])

    rows = rows.withColumn("part", part)
    size = FEATURES + 1
    gram, right = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
    for r in rows.coalesce(8).mapInArrow(sums, "part int, gram binary, right binary").toLocalIterator():
        gram[r.part] += np.frombuffer(r.gram).reshape(size, size)
        right[r.part] += np.frombuffer(r.right)
    others = np.stack([_solved(gram.sum(0) - gram[k], right.sum(0) - right[k]) for k in range(FOLDS)])

    def unseen(batches):
        for batch in batches:
            z, _, own = features(batch)
            yield pa.RecordBatch.from_arrays([pa.array((z * others[own]).sum(axis=1)), batch.column("y")], names=["s", "y"])

    held = np.array([tuple(r) for r in rows.mapInArrow(unseen, "s double, y double").toLocalIterator()])
    return Model(fourier, _solved(gram.sum(0), right.sum(0)), isotonic(held[:, 0], held[:, 1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id`` and ``score`` (0 to 1) of the whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = held.value
        return lambda batch: {"id": batch.column("id"), "score": pa.array(own.score(batch.column("body")))}

    return tables.map_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), f"id {docs.schema[id_col].dataType.simpleString()}, score double", make, "body")
