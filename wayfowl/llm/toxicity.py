"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a bag of character n-grams (with its borders marked) and of itself. Each of them has an embedding and a gate; a word has the
mean of its bag's embeddings, and weighs as much as e to the mean of its bag's gates. A text is the average of its words so weighed,
and a linear softmax gives its probability, so unseen misspellings share vectors and gates with what was seen. Embeddings, gates
and softmax are trained together on the labels of whole texts. The gates learn to pass over what says nothing: without them one
insult drowns among a thousand words. To teach them that, short training texts are shown a second time, filled up with words of
harmless ones; and words are averaged in windows of a text, of which the most toxic gives the score, so that a text's length does
not count.

The model is fitted on a bounded sample of labelled rows (MAX_PER_CLASS rows and MAX_BYTES bytes of text for each class,
chosen by a hash of the id; texts over a sixteenth of MAX_BYTES are not drawn) weighted back to the classes' shares; scoring
covers every whole text.

Defined cases: null text counts as empty and scores 0; rows with a null doc_id and repeated rows are scored like any other;
without labels of both classes every score is the share of toxic labels (0 if there are none); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, id_bucket, short_batches, table, text_bytes

BUCKETS = 1 << 17
DIM = 8
NGRAMS = (3, 4, 5)
MAX_PER_CLASS = 1500
MAX_BYTES = 8 << 20
EPOCHS = 80
#: Pull of embeddings and of gates towards zero: what a single text suggests stays weak, what many share comes through.
DECAY, GATE_DECAY = 3e-5, 1e-5
#: First steps of gates and of all else; a gate's mean counts within these limits.
GATE_RATE, RATE, GATE_LIMIT = 0.2, 0.1, 15.0
#: Words that are averaged at most; the score of a longer text is the largest of its windows'.
WINDOW = 512
#: Words up to which shorter training texts are filled, for a second time of being shown.
FILL = WINDOW
THRESHOLD = 0.5
HELD_OUT = (5, 0)  # crc32(doc_id as text) modulo 5 is 0: its labels are never used
#: Words whose scores a worker remembers at most; longer ones are scored each time.
MEMO_WORDS = 400_000
MEMO_BYTES = 64
#: Bytes of texts, and new words, that are scored at once.
GROUP_BYTES = 2 << 20
GROUP_WORDS = 50_000

# The multiplier of the rolling hash and the one that mixes its bits: odd numbers.
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def bags(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, sizes): the numbers of all words' n-grams and of the words themselves, word after word, and how many each word
    has. Case and marks at a word's ends do not count; what is nothing but marks has none."""
    plain = [w.strip(_EDGES).decode("utf-8", "replace").lower() for w in words]
    marked = [f"<{t}>" if t else "" for t in plain]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of, left = np.repeat(np.arange(len(marked)), length), np.repeat(np.cumsum(length), length) - np.arange(len(chars))
    some = np.flatnonzero(length)
    owners, hashes = [some], [np.fromiter((zlib.crc32(marked[i].encode(), 1) for i in some.tolist()), np.uint64, len(some))]
    rolled = chars
    for n in range(2, NGRAMS[-1] + 1):
        rolled = rolled[:-1] * _FACTOR + chars[n - 1 :]
        if n in NGRAMS:
            at = np.flatnonzero(left[: len(rolled)] >= n)
            owners.append(of[at])
            hashes.append((rolled[at] * _MIX) >> np.uint64(32))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(hashes)[order] % np.uint64(buckets)).astype(np.int32), np.bincount(owner, minlength=len(marked))


def _word_sums(logits: np.ndarray, gates: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its mean logit and its weight, both 0 if it has no n-grams."""
    some = size > 0
    mean, weight = np.zeros(len(size)), np.zeros(len(size))
    if some.any():
        starts, count = (np.cumsum(size) - size)[some], size[some]
        mean[some] = np.add.reduceat(logits[ids], starts) / count
        weight[some] = np.exp(np.clip(np.add.reduceat(gates[ids], starts) / count, -GATE_LIMIT, GATE_LIMIT))
    return mean, weight


def windows(n: int) -> np.ndarray:
    """Where the windows of n words start: as few of equal length as have WINDOW words at most."""
    k = -(-n // WINDOW)
    return np.arange(k) * n // k


@dataclass
class ToxicityModel:
    """logits: for each n-gram, its embedding times the difference of the two softmax rows."""

    logits: np.ndarray
    gates: np.ndarray
    bias: float
    prior: float

    def __post_init__(self) -> None:
        self.memo: dict[bytes, complex] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        """For each word its weighed logit (real part) and its weight (imaginary part)."""
        mean, weight = _word_sums(self.logits, self.gates, *bags(words, len(self.logits)))
        return weight * (mean + 1j)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The score of each text; words that were not met lately are worked out together."""
        if not len(self.logits):
            return np.full(len(texts), self.prior)
        memo, out, at = self.memo, np.zeros(len(texts)), 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= GROUP_BYTES):
                size += len(texts[stop])
                stop += 1
            own = [t.split() for t in texts[at:stop]]
            if len(memo) > MEMO_WORDS:
                memo.clear()
            new = list(set().union(*own).difference(memo))
            for lo in range(0, len(new), GROUP_WORDS):
                memo.update(zip(new[lo : lo + GROUP_WORDS], self.words(new[lo : lo + GROUP_WORDS]).tolist(), strict=True))
            for i, words in enumerate(own, at):
                out[i] = self._text(np.fromiter(map(memo.__getitem__, words), complex, len(words)))
            for w in new:
                if len(w) > MEMO_BYTES:
                    del memo[w]
            at = stop
        return out

    def _text(self, words: np.ndarray) -> float:
        """The largest probability of a text's windows."""
        if not len(words):
            return 0.0
        sums = np.add.reduceat(words, windows(len(words)))
        sums = sums[sums.imag > 0]
        if not len(sums):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip((sums.real / sums.imag).max() + self.bias, -40, 40))))

    def score(self, text: bytes) -> float:
        return float(self.scores([text])[0])


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, prior: float, epochs: int = EPOCHS, decay: float = DECAY, fill: int = FILL, seed: int = 9) -> ToxicityModel:
    """Full-batch Adam on embeddings, softmax rows, gates and bias."""
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros(0), np.zeros(0), 0.0, prior)
    more, of = filled(texts, labels, fill)
    texts, labels, weights = texts + more, np.append(labels, labels[of]), np.append(weights, weights[of])
    number: dict[bytes, int] = {}
    word, times = [], []
    for text in texts:
        counts = Counter(text.split())
        word.append(np.fromiter((number.setdefault(w, len(number)) for w in counts), np.int64, len(counts)))
        times.append(np.fromiter(counts.values(), np.float64, len(counts)))
    doc = np.repeat(np.arange(len(texts)), list(map(len, word)))
    word, times = np.concatenate(word), np.concatenate(times)
    names = list(number)
    ids, size = (np.concatenate(c) for c in zip(*(bags(names[lo : lo + GROUP_WORDS]) for lo in range(0, max(1, len(names)), GROUP_WORDS)), strict=True))
    some, n_words, n_texts = size > 0, len(number), len(texts)
    count = size[some]
    del number, names

    def by_ngram(of_words: np.ndarray) -> np.ndarray:
        return np.bincount(ids, np.repeat(of_words[some] / count, count), BUCKETS)

    rng = np.random.default_rng(seed)
    emb, soft = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.5, (2, DIM))
    values = [emb, soft, np.zeros(BUCKETS), np.array([np.log(prior / (1 - prior))])]
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in values]
    y, weights = labels.astype(np.float64), weights / weights.sum()
    for t in range(1, epochs + 1):
        emb, soft, gates, bias = values
        across = soft[1] - soft[0]
        mean, weight = _word_sums(emb @ across, gates, ids, size)
        total = np.bincount(doc, weight[word] * times, n_texts)
        share = 1 / np.where(total > 0, total, 1.0)
        average = np.bincount(doc, (weight * mean)[word] * times, n_texts) * share
        # Texts without words have no part in it.
        d_z = weights * (1 / (1 + np.exp(-np.clip(average + bias[0], -40, 40))) - y) * (total > 0)
        d_mean = weight * np.bincount(word, (d_z * share)[doc] * times, n_words)
        d_weight = mean * d_mean - weight * np.bincount(word, (d_z * share * average)[doc] * times, n_words)
        d_v = by_ngram(d_mean)
        d_across = emb.T @ d_v
        moves = (d_v[:, None] * across[None, :] + decay * emb, np.stack([-d_across, d_across]) + 1e-6 * soft, by_ngram(d_weight) + GATE_DECAY * gates, np.array([d_z.sum()]))
        for value, (m, v), g, rate in zip(values, state, moves, (RATE, RATE, GATE_RATE, RATE), strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            value -= rate * (1 - t / (epochs + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-12)
    emb, soft, gates, bias = values
    return ToxicityModel(emb @ (soft[1] - soft[0]), gates, float(bias[0]), prior)


def filled(texts: list[bytes], labels: np.ndarray, n: int = FILL, seed: int = 1) -> tuple[list[bytes], np.ndarray]:
    """The texts of fewer than n words, filled up to n with words of harmless ones, and whose they are."""
    rng = np.random.default_rng(seed)
    harmless = [i for i, y in enumerate(labels.tolist()) if not y and texts[i].split(None, 1)]
    out, of = [], []
    for i, text in enumerate(texts):
        words = text.split()
        if words and harmless and len(words) < n:
            while len(words) < n:
                words += texts[harmless[rng.integers(len(harmless))]].split(None, n)[: n - len(words)]
            out.append(b" ".join(words))
            of.append(i)
    return out, np.array(of, np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int] = HELD_OUT, max_per_class: int = MAX_PER_CLASS, max_bytes: int = MAX_BYTES):
    """(texts, labels, counts of both classes): a bounded sample of labelled rows outside the held-out part."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (id_bucket("doc_id", held_out[0]) != held_out[1]))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = [known.where(F.col("y") == c).orderBy(order, "doc_id").limit(max_per_class) for c in (0, 1)]
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    firsts = Window.partitionBy("doc_id").orderBy("text")
    running = Window.partitionBy("y").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # Longer texts teach nothing (they are scored like all), so the first in the order never leave out those behind them.
    fitting = sample.withColumn("k", F.row_number().over(firsts)).where("k = 1").where(size <= max_bytes // 16)
    bounded = fitting.withColumn("bytes", F.sum(size).over(running)).where(F.col("bytes") <= max_bytes)
    rows = bounded.select("doc_id", "text", "y").orderBy("doc_id").collect()
    return [(r.text or "").encode() for r in rows], np.array([r.y for r in rows], np.int64), (counts.get(0, 0), counts.get(1, 0))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = HELD_OUT) -> ToxicityModel:
    texts, y, counts = labelled_sample(docs, labels, label, held_out)
    prior = counts[1] / max(1, sum(counts))
    weights = np.array([counts[c] / max(1, int((y == c).sum())) for c in y.tolist()])
    return fit(texts, y, weights, prior)


def scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(text_bytes(batch, "text")), pa.float64())], names=["doc_id", "score"])

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns; texts are read once and not shuffled."""
    model = train(docs, labels)
    return keep_by_score(docs, lambda texts: model.scores(texts) < threshold)


def keep_by_score(docs: DataFrame, keep: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            yield batch.filter(pa.array(keep(text_bytes(batch, "text")), pa.bool_()))

    short_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (id_bucket("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
