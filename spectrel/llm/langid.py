"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods.

Each language has a distribution over hashed byte trigrams of letters, fitted on a bounded, documented sample of labelled
documents. A document's trigrams are explained as a mixture of these; EM gives the proportions. The set of languages is
then chosen by penalised likelihood: the sets of the 1, 2, ... strongest languages are tried in turn, and one more is
taken only if it raises the log-likelihood by more than ``PENALTY`` times the log of the number of trigrams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_slices, stored

BUCKETS = 1 << 16
#: Labelled documents of each language that the model is fitted on, in the order of their hashed ids.
SAMPLE = 1500
#: Likelihoods (trigrams times languages) that are held at a time, but for a single text's.
ENTRIES = 1 << 22
#: Trigrams overlap, so their likelihood counts letters about three times; the penalty allows for it.
PENALTY = 3.0
STEPS = 12
SMOOTHING = 0.2

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[128:] = np.arange(128, 256)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text and hashed trigram of its letters (runs of anything else: one space): text number, bucket, count."""
    parts = [b"" if not t else t.lower().encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 2
    buf = _LETTERS[np.frombuffer(b" " + b"  ".join(parts) + b" ", np.uint8)]
    owner = np.repeat(np.arange(len(parts)), lengths)
    keep = np.ones(len(buf), bool)
    keep[1:] = (buf[1:] != 32) | (buf[:-1] != 32) | (owner[1:] != owner[:-1])
    buf, owner = buf[keep].astype(np.uint32), owner[keep]
    if len(buf) < 3:
        return (np.zeros(0, np.int64),) * 3
    inside = owner[2:] == owner[:-2]
    code = ((buf[:-2] << 16) | (buf[1:-1] << 8) | buf[2:])[inside]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(16)
    key, count = np.unique((owner[2:][inside] << 16) | bucket, return_counts=True)
    return key >> 16, key & (BUCKETS - 1), count


class Model:
    """Languages in the order of their names, and counts of buckets: how often (``n``) each ``bucket`` occurs in each ``language`` (its place).

    Only what occurs is held, so the model grows with the number of languages and their own trigrams.
    """

    def __init__(self, languages: list[str], bucket: np.ndarray, language: np.ndarray, n: np.ndarray):
        self.languages = languages
        order = np.lexsort((language, bucket))
        self.bucket, self.language, self.n = bucket[order].astype(np.int32), language[order].astype(np.int32), n[order].astype(np.float64)
        self.begins = np.searchsorted(self.bucket, np.arange(BUCKETS + 1)).astype(np.int64)
        self.totals = np.bincount(self.language, self.n, len(languages)) + SMOOTHING * BUCKETS

    def rows(self, bucket: np.ndarray) -> np.ndarray:
        """The probability of each of these buckets in each language."""
        kinds, where = np.unique(bucket, return_inverse=True)
        counts = np.full((len(kinds), len(self.languages)), SMOOTHING)
        sizes = self.begins[kinds + 1] - self.begins[kinds]
        at = np.repeat(self.begins[kinds] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        counts[np.repeat(np.arange(len(kinds)), sizes), self.language[at]] += self.n[at]
        return (counts / self.totals)[where]

    def mixtures(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (texts x languages, zero outside the chosen set) and numbers of trigrams."""
        n, m = len(texts), len(self.languages)
        text, bucket, count = trigrams(texts)
        total = np.bincount(text, count, n)
        pi = np.zeros((n, m))
        if not m or not len(text):
            return pi, total
        ends = np.searchsorted(text, np.arange(1, n + 1))
        lo = 0
        while lo < n:
            first = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, first + ENTRIES // m, side="right")))
            last = int(ends[hi - 1])
            if last > first:
                pi[lo:hi] = self._mixtures(hi - lo, text[first:last] - lo, bucket[first:last], count[first:last], total[lo:hi])
            lo = hi
        return pi, total

    def _mixtures(self, n: int, text: np.ndarray, bucket: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
        m = len(self.languages)
        pi = np.zeros((n, m))
        p, c = self.rows(bucket), count.astype(np.float64)
        full, ll_full = _em(p, c, text, n, np.full((n, m), 1 / m), STEPS)
        order = np.argsort(-full, axis=1, kind="stable")
        top = order[:, 0]
        pi[np.arange(n), top] = 1.0
        ll = np.bincount(text, c * np.log(p[np.arange(len(p)), top[text]]), n)
        price = PENALTY * np.log(np.maximum(total, 2))
        # no set can beat the full one, so most texts are settled here
        open_ = np.flatnonzero((ll_full - ll > price) & (total > 0))
        for size in range(2, m + 1):
            if not len(open_):
                break
            number = np.full(n, -1)
            number[open_] = np.arange(len(open_))
            mine = number[text] >= 0
            start = np.zeros((len(open_), m))
            start[np.arange(len(open_))[:, None], order[open_, :size]] = full[open_[:, None], order[open_, :size]] + 1e-6
            start /= start.sum(axis=1, keepdims=True)
            got, better = _em(p[mine], c[mine], number[text[mine]], len(open_), start, STEPS)
            wins = better - ll[open_] > price[open_]
            pi[open_[wins]], ll[open_[wins]] = got[wins], better[wins]
            open_ = open_[wins & (ll_full[open_] - better > price[open_])]
        return pi

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[str]], list[list[float]]]:
        pi, total = self.mixtures(texts)
        m = len(self.languages)
        names, scores, sets, shares = [], [], [], []
        for text, row, n in zip(texts, pi, total.tolist()):
            if not m or not text or not any(map(str.isalpha, text)):
                names.append("und")
                scores.append(0.0)
                sets.append([])
                shares.append([])
                continue
            order = [i for i in np.argsort(-row, kind="stable").tolist() if row[i] > 0] or [0]
            names.append(self.languages[order[0]])
            # one imagined trigram of each language: little text, little certainty
            scores.append(float((row[order[0]] * n + 1) / (n + m)))
            sets.append([self.languages[i] for i in order])
            shares.append([float(row[i]) for i in order])
        return names, scores, sets, shares


def _em(p: np.ndarray, c: np.ndarray, text: np.ndarray, n: int, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after so many steps, and each text's log-likelihood."""
    present, first = np.unique(text, return_index=True)
    weight = np.add.reduceat(c, first)[:, None]
    pi = pi.copy()
    for _ in range(steps):
        part = p * pi[text]
        part *= (c / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        pi[present] = np.add.reduceat(part, first) / weight
    mix = np.einsum("ij,ij->i", p, pi[text])
    return pi, np.bincount(text, c * np.log(np.maximum(mix, 1e-300)), n)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each language; ids that are held out take no part. Every language is learned."""
    labelled = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~held_out()).select("doc_id", "lang")
    # an even threshold leaves about twice the sample of each language, and the window takes the first of these
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    sizes = stored(labelled.groupBy("lang").agg(F.count("*").alias("c")), "languages")
    near = labelled.withColumn("spot", spot).join(sizes, "lang").where(F.col("spot") * F.col("c") <= F.lit(2.0 * sample * (1 << 31)))
    order = Window.partitionBy("lang").orderBy("spot", "doc_id")
    chosen = stored(near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("doc_id", "lang").distinct(), "sample")
    # at most ``sample`` ids of each language; the planner sends them to all tasks where they are few, by their size on disk
    rows = docs.select("doc_id", "lang", "text").where("lang is not null").join(chosen, ["doc_id", "lang"], "left_semi")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        text, bucket, n = trigrams(batch.column("text").to_pylist())
        which = np.array([names.index(x) for x in langs])[text] if len(text) else text
        key, where = np.unique(which * BUCKETS + bucket, return_inverse=True)
        total = np.bincount(where, n, len(key)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in key // BUCKETS], pa.string()), pa.array(key % BUCKETS), pa.array(total)], ["lang", "bucket", "n"])

    got = map_slices(rows.select("lang", "text"), count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = got.toArrow()  # as many rows as languages have trigrams, BUCKETS of each at most
    languages = sorted(set(found.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(languages)}
    which = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    return Model(languages, found.column("bucket").to_numpy(), which, found.column("n").to_numpy())


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, languages and shares.

    A text that is null or has no letter is ``und`` with score 0; so is every text if nothing was learned. A text of any
    length is read whole: its trigrams are counted first, and there are BUCKETS of them at most. Equally strong
    languages go by name. ``score`` is the language's share, lowered for short texts. Columns of these names are replaced.
    """
    new = ("lang_pred", "score", "languages", "shares")
    kept = docs.drop(*new)
    held = docs.sparkSession.sparkContext.broadcast(model)
    more_fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*kept.schema.fields, *more_fields])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, sets, shares = held.value.predict(batch.column(text_column).to_pylist())
        more = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *new])

    return map_slices(kept, one, schema, text_column)
