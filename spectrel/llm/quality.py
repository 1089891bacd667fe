"""Quality scores: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words and runs of other signs are hashed, alone and in pairs, into ``BUCKETS``; a text is the sparse vector of
log(1 + count), of length one. A word that follows itself is one feature, whatever the word. The model is fitted on a bounded, documented sample of labelled rows; a score is a sparse
dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_slices, mixed, packed_bytes, stored, word_hashes

BUCKETS = 1 << 18
#: A word followed by itself, signs between them aside: one feature for all words.
TWICE = np.uint64(0x9D3A55C1E7B24F60)
#: Labelled rows that the model is fitted on, in the order of their hashed ids.
SAMPLE = 6000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
THRESHOLD = 0.7

#: Classes of bytes: letters, digits and all beyond ASCII; other signs; white space.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_lo:_hi] = 1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and value of each text's features, in the order of the texts."""
    buf, starts, _ = packed_bytes(texts)
    first, _, h = word_hashes(buf, _KIND)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    text = np.searchsorted(starts, first, side="right") - 1
    with np.errstate(over="ignore"):
        pairs = mixed(h[:-1] * np.uint64(3) + h[1:])
    inside = text[1:] == text[:-1]
    word = np.flatnonzero(_KIND[buf[first]] == 1)
    again = word[1:][(h[word[1:]] == h[word[:-1]]) & (text[word[1:]] == text[word[:-1]])]
    owner = np.concatenate((text, text[1:][inside], text[again]))
    bucket = np.concatenate((h, pairs[inside], np.full(len(again), TWICE))) >> np.uint64(64 - 18)
    key, count = np.unique(owner * BUCKETS + bucket.astype(np.int64), return_counts=True)
    owner, value = key // BUCKETS, np.log1p(count)
    norm = np.sqrt(np.bincount(owner, value * value, len(texts)))
    return owner, key % BUCKETS, value / norm[owner]


class Ftrl:
    """Follow-the-regularised-leader with proximal updates, coordinate by coordinate."""

    def __init__(self, buckets: int = BUCKETS):
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ value) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one: the constant), from at most ``sample`` labelled documents that are not held out.

    Labels that repeat count once, as the larger. Without any label all weights are zero and every score is a half.
    """
    known = labels.where(labels["quality"].isNotNull() & labels["doc_id"].isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, bucket, value = features(batch.column("text"))
        bounds = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), *lists], ["doc_id", "quality", "at", "value"])

    got = map_slices(rows.select("doc_id", "quality", "text"), one, "doc_id long, quality int, at array<int>, value array<float>").toArrow()
    hashes = np.asarray(got.column("doc_id").to_numpy(), np.int64).view(np.uint64)
    order = np.argsort(mixed(hashes), kind="stable") if len(hashes) else []
    at = [np.append(x.values.to_numpy(), BUCKETS) for x in got.column("at")]
    value = [np.append(x.values.to_numpy().astype(float), 0.2) for x in got.column("value")]
    label = got.column("quality").to_pylist()
    model = Ftrl()
    for _ in range(epochs):
        for i in order:
            model.learn(at[i], value[i], float(label[i] > 0))
    return model.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for each document. Null and empty texts have no features: the constant alone scores them."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = held.value
        owner, bucket, value = features(batch.column("text"))
        p = sigmoid(np.bincount(owner, w[bucket] * value, batch.num_rows) + 0.2 * w[BUCKETS])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_slices(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), one, "doc_id long, score double, predicted int")
