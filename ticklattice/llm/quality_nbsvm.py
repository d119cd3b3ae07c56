"""Quality scores by naive Bayes support vectors over n-gram indicators.

Features are which byte n-grams (1 to ORDER) a text has, hashed, each scaled by the
log ratio of how often the two classes have it. A linear hinge-loss model on the
scaled indicators is fitted by dual coordinate descent, and its margins are turned
into probabilities of label 1 by a logistic curve fitted to held-out margins.

The model is fitted on about SAMPLE labelled rows, chosen by a hash. Executors turn
their texts into indicators (4 bytes each, 1 MB a row at most, however long the text
is), from which the driver fits it; conflicting labels of a doc_id count as 1. Null counts as empty; an empty text has no indicator
and gets the score of the model's bias. With no labels, or of one class only, every
score is the share of label 1 (0.5 without labels). Rows are kept one to one; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_crf import in_training
from .storage import slices, text_bytes

ORDER, BITS = 4, 18
SAMPLE = 3000
PENALTY, EPOCHS, FOLDS = 1.0, 12, 4
_M = np.uint64(0x9E3779B97F4A7C15)


class Indicators:
    """Which hashed n-grams a text has; one array of flags serves for all texts."""

    def __init__(self):
        self.flags = np.zeros(1 << BITS, bool)

    def __call__(self, data: bytes) -> np.ndarray:
        b = np.frombuffer(data, np.uint8).astype(np.uint64)
        h = np.zeros(len(b), np.uint64)
        for n in range(1, ORDER + 1):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * np.uint64(257) + b[n - 1 :] + np.uint64(1)
            self.flags[((h * _M) >> np.uint64(64 - BITS)).astype(np.int64)] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found.astype(np.int32)


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    sums = []
    for y in (1, 0):
        own = [x for x, z in zip(rows, labels, strict=True) if z == y]
        p = 1.0 + np.bincount(np.concatenate(own), minlength=1 << BITS)
        sums.append(np.log(p / (len(own) + 2)))
    return sums[0] - sums[1]


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, seed: int = 0, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model on unit-length rows: |w|^2 / 2 + bias^2 / 2 + PENALTY * losses is least."""
    rng = np.random.default_rng(seed)
    y = np.where(labels == 1, 1.0, -1.0)
    norm = [max(1e-12, float(np.sqrt((ratio[x] ** 2).sum()))) for x in rows]
    alpha, w, bias = np.zeros(len(rows)), np.zeros(len(ratio)), 0.0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            v = ratio[x] / norm[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1), 0.0), PENALTY)
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w, bias


class Model:
    """score(texts as bytes) -> probability of label 1."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.weights, self.ratio, self.bias, self.curve = prior, None, None, 0.0, (1.0, 0.0)

    def margin(self, x: np.ndarray) -> float:
        r = self.ratio[x]
        return float(self.weights[x] @ r / max(1e-12, np.sqrt(r @ r))) + self.bias

    def fit(self, rows: list[np.ndarray], labels: list[int]) -> Model:
        """rows: the indicators of each text."""
        y = np.array(labels)
        if not len(y):
            return self
        self.prior = float(y.mean())
        if self.prior in (0.0, 1.0):
            return self
        fold, margins = np.arange(len(y)) % FOLDS, np.zeros(len(y))
        for k in range(FOLDS):
            part = np.flatnonzero(fold != k)
            if len(set(y[part])) < 2:
                continue
            own = [rows[i] for i in part]
            self.ratio = log_ratios(own, y[part])
            self.weights, self.bias = dual_descent(own, y[part], self.ratio)
            for i in np.flatnonzero(fold == k):
                margins[i] = self.margin(rows[i])
        self.curve = _logistic(margins, y)
        self.ratio = log_ratios(rows, y)
        self.weights, self.bias = dual_descent(rows, y, self.ratio)
        return self

    def score(self, texts: list[bytes]) -> list[float]:
        if self.weights is None:
            return [self.prior] * len(texts)
        get, (a, b) = Indicators(), self.curve
        return [float(1 / (1 + np.exp(-np.clip(a * self.margin(get(t)) + b, -500, 500)))) for t in texts]


def _logistic(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, targets drawn in a little."""
    pos = labels.sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (len(labels) - pos + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-6)), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on about `sample` rows of labels (doc_id, quality) that have a document."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(u < min(1.0, sample / max(1, n))).withColumn("quality", F.col("quality").cast("int"))  # about `sample` rows: small whatever the tables' size

    def run(batches):
        get = Indicators()
        for whole in batches:
            for b in slices(whole, "text", 8_000_000):
                own = pa.array([get(t).tobytes() for t in text_bytes(b, "text")], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality").cast(pa.int32()), own], names=["doc_id", "quality", "own"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = sorted(map(tuple, rows.mapInArrow(run, "doc_id long, quality int, own binary").collect()))
    return Model().fit([np.frombuffer(r[2], np.int32) for r in rows], [r[1] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for each row of docs (doc_id, text)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 8_000_000):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(text_bytes(batch, "text")), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op_query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.where(in_training(F.col("doc_id"), 5, 0)))
    return score(docs, model).select("doc_id", (~in_training(F.col("doc_id"), 5, 0)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
