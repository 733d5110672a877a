"""Quality classification by positive-unlabelled learning.

Only trusted positives and unlabelled web text train the model: with class prior p, the risk is
p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)]), the non-negative unbiased risk under the logistic loss; when
its second part falls below zero, the step goes the other way. The prior is estimated as the share of label 1 among the
training labels. The model is linear in hinge features of a text's surface statistics (case, symbols, separators, repetition,
word and line shapes), so its score is a probability.

Texts are reduced to some twenty numbers where they lie. The trusted positives are bounded: the MAX_POSITIVE whose ids have the
smallest hashes. The unlabelled part of the risk, its gradient, the hinges' places and the features' scale are over all texts outside
the held-out part, one row an id (of repeated ids the least features), summed up in the tasks in each of PASSES passes at most. As
long as its second part is not below zero the risk is convex, so passes that use the gradient of all rows and the curvature of a
sample of START_ROWS rows come to the same minimum whatever the sample is; a step that raises the risk, or takes its second part
below zero, goes back. Every whole text is scored.

Defined cases: null text counts as empty and is scored like any text; rows with a null doc_id and repeated rows are scored like
any other; without positives every score is the estimated prior (0.5 without any labels); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, id_bucket, short_batches, table, text_bytes, written
from .toxicity import keep_by_score

MAX_POSITIVE = 6000
#: Rows that give the start and the curvature of steps, which decide how many passes are needed, not where they lead.
START_ROWS = 6000
PASSES = 12
#: Passes end when no part of the gradient is above this.
FLAT = 1e-5
DECAY = 1e-4
THRESHOLD = 0.3
HELD_OUT = (5, 0)  # crc32(doc_id as text) modulo 5 is 0: its labels are never used
KNOTS = (0.05, 0.2, 0.4, 0.6, 0.8, 0.95, 0.99)
EPOCHS = 600

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"
_STOPS = b".,;:?'\"-()"
_SYMBOLS = bytes(c for c in range(33, 127) if c not in _LETTERS + _DIGITS + _STOPS + b"|!")
_HIGH = bytes(range(128, 256))

FEATURES = (
    "log_bytes", "upper", "symbols", "pipes", "shouts", "digits", "stops", "high", "distinct_words", "same_neighbour", "commonest_word",
    "mean_word", "long_words", "words_per_line", "distinct_lines", "ends_with_stop", "log_words", "upper_words", "short_words", "capital_starts",
)


def features(text: bytes) -> list[float]:
    """Surface statistics of a whole text, as FEATURES names them."""
    n = max(1, len(text))

    def share(kinds: bytes) -> float:
        return 1 - len(text.translate(None, kinds)) / n if text else 0.0

    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        float(np.log1p(len(text))), share(_UPPER), share(_SYMBOLS), share(b"|"), share(b"!"), share(_DIGITS), share(_STOPS), share(_HIGH),
        len(counts) / k, sum(map(eq, words, words[1:])) / k, max(counts.values(), default=0) / k,
        float(lengths.mean()) if words else 0.0, float((lengths > 20).sum()) / k, k / max(1, len(lines)), len(set(lines)) / max(1, len(lines)),
        float(text.rstrip()[-1:] in (b".", b"!", b"?")), float(np.log1p(len(words))), sum(map(bytes.isupper, words)) / k, float((lengths < 3).sum()) / k, sum(map(bytes.istitle, words)) / k,
    ]


def feature_rows(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, extra columns, x): x has the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            x = pa.array([features(t) for t in text_bytes(batch, "text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in extra), x], names=["doc_id", *extra, "x"])

    short_batches(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(c) for c in extra), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, " + "".join(f"{c} int, " for c in extra) + "x array<double>")


@dataclass
class QualityModel:
    knots: np.ndarray  # features x knots
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        hinges = np.maximum(0.0, x[:, :, None] - self.knots[None]).reshape(len(x), -1)
        return np.concatenate([x, hinges], axis=1) / self.scale

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights + self.bias, -30, 30)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.predict(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES)))

    def score(self, text: bytes) -> float:
        return float(self.scores([text])[0])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, knots: np.ndarray | None = None, scale: np.ndarray | None = None) -> QualityModel:
    """Minimises the non-negative risk of rows by full-batch Adam."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros((len(FEATURES), 0)), np.ones(1), np.zeros(0), 0.0, prior)
    if knots is None:
        knots = np.quantile(np.concatenate([positive, unlabelled]), KNOTS, axis=0).T
    model = QualityModel(knots, np.ones(1), np.zeros(0), 0.0, prior)
    spread = np.abs(model.expand(np.concatenate([positive, unlabelled]))).max(axis=0) if scale is None else scale
    model.scale = np.where(spread > 0, spread, 1.0)
    p, u = model.expand(positive), model.expand(unlabelled)
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for t in range(1, epochs + 1):
        gp, gu = 1 / (1 + np.exp(-(p @ w + b))), 1 / (1 + np.exp(-(u @ w + b)))
        negative = np.logaddexp(0, u @ w + b).mean() - prior * np.logaddexp(0, p @ w + b).mean()
        d_pos = (prior * p.T @ (gp - 1) / len(p), prior * (gp - 1).mean())
        d_neg = (u.T @ gu / len(u) - prior * p.T @ gp / len(p), gu.mean() - prior * gp.mean())
        g = np.append(*(a + c for a, c in zip(d_pos, d_neg, strict=True))) if negative >= 0 else -np.append(*d_neg)
        g[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 * (1 - t / (epochs + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)
        w, b = w - step[:-1], b - float(step[-1])
    model.weights, model.bias = w, b
    return model


def _unlabelled_part(rows: DataFrame, model: QualityModel) -> tuple[float, np.ndarray]:
    """Mean of the loss of all rows as negatives, and its gradient (weights, bias). What comes to the driver has the gradient's size."""
    size = len(model.weights) + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = model.expand(_matrix(batch.column("x")))
                z = x @ model.weights + model.bias
                p = 1 / (1 + np.exp(-z))
                sums += [len(z), np.logaddexp(0, z).sum(), *(x.T @ p), p.sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(sums)], names=["k", "v"])

    found = rows.select("x").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(size)
    for r in found:
        sums[r.k] = r.v
    return sums[1] / sums[0], sums[2:] / sums[0]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(FEATURES))


def refine(model: QualityModel, positive: np.ndarray, sample: np.ndarray, rows: DataFrame, passes: int = PASSES) -> QualityModel:
    """The model at the least risk over positive and all rows, starting from model. sample gives the curvature."""
    p, u = np.column_stack([model.expand(positive), np.ones(len(positive))]), np.column_stack([model.expand(sample), np.ones(len(sample))])
    pull, decay = model.prior * p.mean(axis=0), np.append(np.full(len(model.weights), DECAY), 0.0)

    def risk(w: np.ndarray) -> tuple[float, np.ndarray, bool]:
        model.weights, model.bias = w[:-1], float(w[-1])
        loss, gradient = _unlabelled_part(rows, model)
        # loss(+) - loss(-) is -z, so that the positives' part is linear.
        return loss - pull @ w + 0.5 * decay @ w**2, gradient - pull + decay * w, loss >= model.prior * np.logaddexp(0, p @ w).mean()

    w = np.append(model.weights, model.bias)
    value, gradient, whole = risk(w)
    damping, tried = 0.0, 1
    while tried < passes and np.abs(gradient).max() > FLAT:
        s = 1 / (1 + np.exp(-u @ w))
        curve = (u * (s * (1 - s))[:, None]).T @ u / len(u) + np.diag(decay + 1e-9)
        way = np.linalg.solve(curve + damping * np.diag(np.diag(curve)), gradient)
        new, tried = risk(w - way), tried + 1
        if new[0] <= value and (new[2] or not whole):
            w, (value, gradient, whole), damping = w - way, new, damping / 4
        else:
            damping = max(0.25, 4 * damping)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def fit_rows(rows: DataFrame, trusted: DataFrame, prior: float, start_rows: int = START_ROWS, passes: int = PASSES) -> QualityModel:
    """The model of rows (doc_id, x), of which those of the ids in trusted, a bounded number, are positives."""
    rows = written(rows.groupBy("doc_id").agg(F.min("x").alias("x")))
    positive = np.array([r.x for r in rows.join(F.broadcast(trusted), "doc_id", "left_semi").orderBy("doc_id").collect()]).reshape(-1, len(FEATURES))
    order = F.xxhash64("doc_id", F.lit(13))
    sample = np.array([r.x for r in rows.orderBy(order, "doc_id").limit(start_rows).collect()]).reshape(-1, len(FEATURES))
    if not len(positive) or not len(sample):
        return fit(positive, sample, prior)
    parts = rows.select(*(F.col("x")[i].alias(f"x{i}") for i in range(len(FEATURES)))).agg(*(F.percentile_approx(f"x{i}", list(KNOTS), 10_000).alias(f"k{i}") for i in range(len(FEATURES))), *(f(f"x{i}").alias(f"{n}{i}") for i in range(len(FEATURES)) for n, f in (("low", F.min), ("high", F.max)))).first()
    knots = np.array([parts[f"k{i}"] for i in range(len(FEATURES))])
    low, high = (np.array([parts[f"{n}{i}"] for i in range(len(FEATURES))]) for n in ("low", "high"))
    scale = np.concatenate([np.maximum(np.abs(low), np.abs(high)), np.maximum(0.0, high[:, None] - knots).ravel()])
    return refine(fit(positive, sample, prior, knots=knots, scale=scale), positive, sample, rows, passes)


def trusted_ids(labels: DataFrame, label: str, held_out: tuple[int, int], max_positive: int) -> tuple[DataFrame, float]:
    """(doc_id) of the positives that are learnt from, and the estimated prior."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & _outside(held_out)).groupBy("doc_id").agg(F.min("y").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    return known.where("y = 1").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_positive).select("doc_id"), prior


def _outside(held_out: tuple[int, int]) -> Column:
    return F.col("doc_id").isNotNull() & (id_bucket("doc_id", held_out[0]) != held_out[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = HELD_OUT, max_positive: int = MAX_POSITIVE, rows: DataFrame | None = None) -> QualityModel:
    """Fits on bounded positives and all texts outside the held-out part. rows: feature_rows() of docs, if they are at hand."""
    trusted, prior = trusted_ids(labels, label, held_out, max_positive)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return fit_rows(feature_rows(own.where(_outside(held_out))) if rows is None else rows.where(_outside(held_out)), trusted, prior)


def scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row."""
    return row_scores(feature_rows(docs), model)


def row_scores(rows: DataFrame, model: QualityModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.predict(_matrix(batch.column("x"))), pa.float64())], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def only_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns; texts are not shuffled."""
    model = train(docs, labels)
    return keep_by_score(docs, lambda texts: model.scores(texts) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = written(feature_rows(docs))
    found = row_scores(rows, train(docs, table(spark, sf_dir, "labels"), rows=rows))
    return found.select("doc_id", (id_bucket("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
