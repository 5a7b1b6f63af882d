"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each document becomes a vector of transformed statistics of its whole text. Every executor sums, per class, counts,
vectors and outer products of the labelled rows; the driver gets these few hundred numbers, shrinks the class
covariances towards their mean and a ridge, and keeps the Cholesky factors. A score is the difference of the classes'
log densities (Mahalanobis distances from the cached factors), brought to 0..1 by a logistic curve whose two
parameters are fitted on the training rows. All labelled rows train; there is no sample.

Cases: a null text counts as empty and gets a score; repeated documents are scored row by row; documents with repeated
or null labels train once for each label that is 0 or 1; if one class has no training rows all scores are 1 (or 0 if
only class 0 has); without any labels they are 0.5; other columns are ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerloom.llm.common import LOWER, SPACE, byte_hash, crc_mod, in_arrow, joined, slices, span_hash, unused, word_spans, written

THRESHOLD = 0.7
SHRINK = 0.1
RIDGE = 1e-3
_UPPER, _DIGIT, _ALPHA, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_SYMBOL[33:127] = ~(_ALPHA | _DIGIT)[33:127]
_STOPS = np.zeros(256, bool)
_STOPS[[44, 46, 63, 33, 59, 58]] = True
FEATURES = 16


def features(texts: list[bytes]) -> np.ndarray:
    """(texts, FEATURES): logs and square roots of sizes and shares that do not depend on the language's letters."""
    data, starts, lens = joined(texts)
    ends = starts + lens
    per = lambda mask: (c := np.concatenate(([0], np.cumsum(mask))))[ends] - c[starts]
    b, e = word_spans(~SPACE[data])
    h = span_hash(byte_hash(LOWER[data]), b, e)
    first = np.searchsorted(b, starts)
    n_words = np.append(first[1:], len(b)) - first
    doc = np.repeat(np.arange(len(texts)), n_words)
    per_word = lambda x: np.bincount(doc, x, len(texts))
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))) if len(h) else np.zeros(0, bool)
    pair = h * np.uint64(31) + np.append(h[1:], np.uint64(0))
    distinct = lambda x: np.bincount(doc[np.unique(x + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]], minlength=len(texts))
    sym = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    odd = (sym[e] - sym[b] >= 2) | ((sym[e] - sym[b] == e - b) if len(b) else False)
    nb, nw = np.maximum(lens, 1), np.maximum(n_words, 1)
    alpha = per(_ALPHA[data])
    cols = [
        np.log1p(lens), np.log1p(n_words), np.log1p(per_word(e - b) / nw), np.sqrt(per_word((e - b - per_word(e - b)[doc] / nw[doc]) ** 2) / nw),
        np.sqrt(per(_UPPER[data]) / np.maximum(alpha, 1)), np.sqrt(per(_DIGIT[data]) / nb), np.sqrt(per(_SYMBOL[data]) / nb), np.sqrt(per(data == 10) / nb),
        np.sqrt(np.maximum(0, 1 - distinct(h) / nw)), np.sqrt(np.maximum(0, 1 - distinct(pair) / nw)), np.sqrt(per_word(same) / nw), np.sqrt(per_word(odd) / nw),
        np.sqrt(per(_STOPS[data]) / nw), np.sqrt(per_word(e - b <= 3) / nw), np.sqrt(per_word(e - b >= 12) / nw), np.sqrt(per(data == 124) / nw),
    ]
    return np.stack(cols, 1)


@dataclass
class Discriminant:
    """Means, Cholesky factors and log determinants of the classes, and the logistic curve over the density difference."""

    means: np.ndarray
    factors: np.ndarray
    offset: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 minus that of class 0."""
        out = []
        for c in (0, 1):
            z = np.linalg.solve(self.factors[c], (x - self.means[c]).T)
            out.append(self.offset[c] - 0.5 * (z * z).sum(0))
        return out[1] - out[0]

    def squashed(self, x: np.ndarray) -> np.ndarray:
        """The difference on a scale that keeps its order and does not run off for documents far from both classes."""
        return np.arcsinh(self.difference(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.squashed(x) + self.shift, -30, 30)))


def train(rows: DataFrame) -> Discriminant:
    """``rows``: x array<double>, label 0 or 1. Two passes: moments of the classes, then counts of the difference for the curve."""
    spark = rows.sparkSession

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
        for x, y in _arrays(batches):
            for c in (0, 1):
                v = x[y == c]
                total[c] += np.concatenate(([len(v)], v.sum(0), (v.T @ v).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist())], ["label", "m"])

    size = 1 + FEATURES + FEATURES * FEATURES
    parts = rows.transform(in_arrow, moments, "label int, m array<double>").groupBy("label").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(size)]).alias("m"))
    got = {r.label: np.array(r.m) for r in parts.collect()}
    n = [float(got[c][0]) if c in got else 0.0 for c in (0, 1)]
    if not (n[0] and n[1]):
        none = np.zeros((2, 0))
        return Discriminant(none, none, none, constant=0.5 if n == [0, 0] else float(n[1] > 0))
    means = np.stack([got[c][1 : 1 + FEATURES] / n[c] for c in (0, 1)])
    cov = np.stack([got[c][1 + FEATURES :].reshape(FEATURES, FEATURES) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    shrunk = [(1 - SHRINK) * cov[c] + SHRINK * np.diag(np.diag(pooled)) + RIDGE * np.eye(FEATURES) for c in (0, 1)]
    factors = np.stack([np.linalg.cholesky(s) for s in shrunk])
    model = Discriminant(means, factors, np.array([-np.log(np.diag(f)).sum() for f in factors]))
    held = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _arrays(batches):
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.round(held.value.squashed(x) * 8).astype(np.int32)), pa.array(y.astype(np.int32))], ["bin", "label"])

    bins = rows.transform(in_arrow, binned, "bin int, label int").groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("n")).collect()
    z, k, m = (np.array([r[i] for r in bins], float) for i in range(3))
    model.slope, model.shift = logistic(z / 8, k, m)
    return model


def logistic(z: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(1) = 1 / (1 + exp(-(a z + b))) over binned counts, with a small penalty so that a and b stay finite."""
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = x.T @ (ones - n * p) - np.array([1.0, 0.1]) * [a, b]
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag([1.0, 0.1]), g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield np.array(b.column("x").to_pylist(), float).reshape(-1, FEATURES), b.column("label").to_numpy()


def with_vectors(docs: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Some columns of ``docs``, and the statistics of each row's text in the column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([*map(part.column, columns), pa.array(features(texts).tolist(), pa.list_(pa.float64()))], [*columns, name])

    return docs.transform(in_arrow, run, T.StructType([*map(docs.schema.__getitem__, columns), T.StructField(name, T.ArrayType(T.DoubleType()))]))


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row."""
    return with_vectors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "x", ["doc_id"])


def fit(scored: DataFrame, labels: DataFrame) -> Discriminant:
    """Trains on the labelled rows that are not held out."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(F.col("label").isin(0, 1) & (crc_mod("doc_id", 4) != 2))
    return train(scored.where(crc_mod("doc_id", 4) != 2).join(good, "doc_id").select("x", F.col("label").cast("int").alias("label")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: whether it was held out, its score and the label that the threshold gives."""
    scored = written(vectors(docs))
    model = scored.sparkSession.sparkContext.broadcast(fit(scored, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.value.score(np.array(b.column("x").to_pylist(), float).reshape(-1, FEATURES))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = scored.transform(in_arrow, run, "doc_id long, score double")
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns; texts are not shuffled, and their statistics, written beside them, serve both the fit and the scores."""
    name = unused("x", docs.columns)
    held = written(with_vectors(docs, name, docs.columns))
    model = docs.sparkSession.sparkContext.broadcast(fit(held.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("x")), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(name).to_pylist(), float).reshape(-1, FEATURES)
                yield b.drop_columns([name]).filter(pa.array(model.value.score(x) >= threshold))

    return held.transform(in_arrow, run, docs.schema)
