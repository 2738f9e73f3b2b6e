"""Quality classifier with supervised subword embeddings.

Features of a text are its words, for each word whether it echoes the one before, and the character n-grams of orders ``ORDERS`` over
its bytes, hashed to ``BUCKETS`` buckets. Each bucket has a learned vector; a document is the average of its features' vectors, and a softmax layer turns that into class
probabilities. Vectors and layer are trained together by stochastic gradient descent in numpy.

Training uses a bounded sample of labelled rows: the ``SAMPLE`` with the smallest MD5 of the id, each reduced in tasks to its bucket
counts, so what reaches the trainer is at most ``SAMPLE * BUCKETS`` numbers whatever the texts' lengths. Rows of the held-out
fold are never read. Scoring runs in tasks over all whole texts: since averaging and the layer are linear, the
learned vectors are multiplied with the layer first and a text's score is a mean of one number a feature.

Inputs are the text alone. Defined results: a null or empty text has no features and scores the bias; labels other than 0 and 1, or
null, are not learnt from; ids labelled twice count twice; without a usable label of both classes every score is 0.5 or the
share learnt; equal rows get equal results; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltlab.llm import tokens as T
from tiltlab.llm.exchange import framed, unframed

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
ORDERS = (2, 3, 4)
DIMENSIONS = 16
EPOCHS = 12
RATE = 0.1
SAMPLE = 4096
SEED = 7


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of every byte n-gram of ``data`` (also those that cross texts)."""
    total = np.full(len(data) - order + 1, order, np.uint64)
    for k in range(order):
        total = total * np.uint64(257) + data[k : len(data) - order + 1 + k]
    return (T.mix(total) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _groups(found: T.Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per feature kind: bucket of each feature and where each text's features begin and end."""
    yield (T.mix(found.hash ^ np.uint64(T.SEQ2)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), found.first[:-1], found.first[1:]
    echo = np.zeros(len(found.hash), bool)
    echo[1:] = found.hash[1:] == found.hash[:-1]
    echo[found.first[:-1][found.first[:-1] < len(echo)]] = False
    yield np.where(echo, 0, 1), found.first[:-1], found.first[1:]
    for order in ORDERS:
        if len(found.data) >= order:
            grams = _grams(found.data, order)
            first = np.minimum(found.offsets[:-1], len(grams))
            yield grams, first, np.clip(found.offsets[1:] - order + 1, first, len(grams))


def bucket_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with its text reduced to ``buckets`` and ``counts`` (both framed arrays)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches):
            found = T.words(piece.column("text"))
            groups = list(_groups(found))
            ids, counts = [], []
            for i in range(len(found)):
                total = np.zeros(BUCKETS, np.int64)
                for bucket, first, last in groups:
                    total += np.bincount(bucket[first[i] : last[i]], minlength=BUCKETS)
                used = np.flatnonzero(total)
                ids.append(framed(used.astype(np.int32)))
                counts.append(framed(total[used].astype(np.float32)))
            yield pa.RecordBatch.from_arrays([piece.column("quality"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["quality", "buckets", "counts"])

    return docs.select("quality", "text").mapInArrow(count, "quality int, buckets binary, counts binary")


class Embeddings:
    """Bucket vectors and softmax layer of two classes."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1.0 / DIMENSIONS, 1.0 / DIMENSIONS, (BUCKETS, DIMENSIONS))
        self.layer = rng.uniform(-1.0, 1.0, (DIMENSIONS, 2))
        self.bias = np.zeros(2)
        self.squares = np.zeros(BUCKETS)  # of the buckets' gradients so far; scales their steps

    def step(self, buckets: np.ndarray, weights: np.ndarray, label: int, rate: float) -> None:
        """One example: ``weights`` are the shares of its features."""
        hidden = weights @ self.vectors[buckets]
        logits = hidden @ self.layer + self.bias
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1.0
        back = self.layer @ p
        self.layer -= 0.1 * rate * np.outer(hidden, p)
        self.bias -= 0.1 * rate * p
        self.squares[buckets] += weights**2 * np.mean(back**2)
        self.vectors[buckets] -= (rate * weights / np.sqrt(self.squares[buckets] + 1e-12))[:, None] * back

    def weights(self) -> tuple[np.ndarray, float]:
        """The log odds of class 1 as one number a bucket, and the bias."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0]), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[int, bytes, bytes]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Embeddings:
    """Stochastic gradient descent over (label, buckets, counts); the classes are drawn equally often."""
    model = Embeddings(seed)
    examples = []
    for label, buckets, counts in rows:
        ids, n = unframed(buckets, np.int32), unframed(counts, np.float32).astype(float)
        if len(ids):
            examples.append((label, ids, n / n.sum()))
    by_class = [[e for e in examples if e[0] == k] for k in (0, 1)]
    if not by_class[0] or not by_class[1]:
        if examples:
            share = (len(by_class[1]) + 1) / (len(examples) + 2)
            model.bias[1] = np.log(share / (1 - share))
        return model
    rng = np.random.default_rng(seed)
    steps = epochs * len(examples)
    for step in range(steps):
        own = by_class[step % 2]
        label, ids, weights = own[rng.integers(len(own))]
        model.step(ids, weights, label, rate * (1 - step / steps))
    return model


def sample_labels(docs: DataFrame, labels: DataFrame, fold, size: int = SAMPLE) -> DataFrame:
    """Texts and labels to learn from: the ``size`` labelled rows with the smallest hash, none of ``fold``.

    Ids are chosen from the labels alone, and held-out rows drop out before the join.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality")).where(~fold)
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "quality").limit(size)
    return docs.select("doc_id", "text").join(chosen, "doc_id")


def score(docs: DataFrame, model: Embeddings) -> DataFrame:
    """doc_id and the probability of class 1 of every row."""
    weights, bias = model.weights()
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for piece in T.pieces(batches):
            found = T.words(piece.column("text"))
            total, features = np.zeros(len(found)), np.zeros(len(found))
            for bucket, first, last in _groups(found):
                sums = np.concatenate([[0.0], np.cumsum(weights[bucket])])
                total += sums[last] - sums[first]
                features += last - first
            logit = np.clip(total / np.maximum(features, 1) + bias, -500, 500)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(1.0 / (1.0 + np.exp(-logit)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, fold, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; ``fold`` is a condition on doc_id that marks held-out rows."""
    rows = [tuple(r) for r in bucket_counts(sample_labels(docs, labels, fold, size)).collect()]
    rows.sort()
    scored = score(docs, train(rows))
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
