"""Maximum inner product search with score-aware (anisotropic) product quantisation.

A vector is coded by 16 centroids for each pair of components, four bits each. Codebooks and codes minimise a residual
whose part along the vector weighs more than the rest, as that part is what changes large inner products. A query's table
of inner products with all centroids then scores codes by look-ups, two codes at a time. The residual's part along
the vector, a known share of it, is made up for; the part across it is an error of a random sign. The best by code are
scored with the vectors themselves, and so is every other whose code score is within SURE standard errors of the K + 1st
of these. So codes decide at every size, nothing is capped, and groups whose codes can't tell their members apart are
scored whole.

Equal vectors are coded once and keep the K + 1 least ids: no others of them can be among anyone's K nearest. Queries
and vectors meet block by block; a block's rows are bounded, so no task grows with the table.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 20
CENTROIDS = 16
PAIR = 2
#: Vectors that the codebooks are fitted on, in the order of their hashed ids.
SAMPLE = 10_000
#: Inner products above this share of the vector's length are those that matter; it sets the weight of the parallel error.
THRESHOLD = 0.2
#: Standard errors of the code score that are allowed for.
SURE = 3.0
#: So many times the vectors asked for are scored first; the least of the best of these is the bar for all others.
FIRST = 4
#: Blocks at least, and rows of a block and queries of a turn at most.
BLOCKS, BLOCK_ROWS, QUERY_ROWS = 8, 1 << 16, 1 << 16


class Codebook:
    """Centroids: subspaces x CENTROIDS x PAIR. Vectors of odd length end with a zero."""

    def __init__(self, sample: np.ndarray, rounds: int = 6, seed: int = 5):
        x = _even(sample)
        rng = np.random.default_rng(seed)
        m = x.shape[1] // PAIR
        self.dim = sample.shape[1]
        eta = (self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2) if self.dim > 1 else 1.0
        self.weight = max(0.0, eta - 1)
        self.centroids = np.zeros((m, CENTROIDS, PAIR))
        parts = x.reshape(len(x), m, PAIR)
        for s in range(m):
            self.centroids[s] = _kmeans(parts[:, s], rng)
        for _ in range(rounds):
            codes = self.encode(sample, 1)
            self._refit(parts, codes)

    def _refit(self, parts: np.ndarray, codes: np.ndarray) -> None:
        norm = np.maximum((parts**2).sum(axis=(1, 2)), 1e-30)
        along = self._along(parts, codes)
        for s in range(parts.shape[1]):
            x, c = parts[:, s], self.centroids[s]
            rest = along.sum(axis=1) - along[:, s]
            for j in range(CENTROIDS):
                mine = codes[:, s] == j
                if not mine.any():
                    continue
                v, w = x[mine], self.weight / norm[mine]
                a = mine.sum() * np.eye(PAIR) + (v * w[:, None]).T @ v
                b = v.sum(axis=0) + (v * (w * (rest[mine] + (v**2).sum(axis=1)))[:, None]).sum(axis=0)
                c[j] = np.linalg.solve(a, b)
            along[:, s] = ((x - c[codes[:, s]]) * x).sum(axis=1)

    def _along(self, parts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        chosen = self.centroids[np.arange(parts.shape[1]), codes]
        return ((parts - chosen) * parts).sum(axis=2)

    def encode(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n x subspaces) that minimise the weighted residual, one subspace after another."""
        x = _even(vectors)
        n, m = len(x), self.centroids.shape[0]
        parts = x.reshape(n, m, PAIR)
        codes = np.zeros((n, m), np.int64)
        plain = np.empty((m, n, CENTROIDS))
        for s in range(m):
            plain[s] = ((parts[:, s, None] - self.centroids[s]) ** 2).sum(axis=2)
            codes[:, s] = plain[s].argmin(axis=1)
        w = self.weight / np.maximum((parts**2).sum(axis=(1, 2)), 1e-30)
        along = self._along(parts, codes)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for s in range(m):
                v = parts[:, s]
                option = (v**2).sum(axis=1)[:, None] - v @ self.centroids[s].T
                rest = total - along[:, s]
                codes[:, s] = (plain[s] + w[:, None] * (rest[:, None] + option) ** 2).argmin(axis=1)
                along[:, s] = option[np.arange(n), codes[:, s]]
                total = rest + along[:, s]
        return codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with all pairs of codes: n x subspace pairs x CENTROIDS**2."""
        q = _even(queries)
        one = np.einsum("nsp,scp->nsc", q.reshape(len(q), -1, PAIR), self.centroids)
        if one.shape[1] % 2:
            one = np.concatenate((one, np.zeros((len(q), 1, CENTROIDS))), axis=1)
        return (one[:, ::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, CENTROIDS**2).astype(np.float32)


def paired(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte: subspace pairs x n."""
    if codes.shape[1] % 2:
        codes = np.concatenate((codes, np.zeros((len(codes), 1), codes.dtype)), axis=1)
    return np.ascontiguousarray((codes[:, ::2] * CENTROIDS + codes[:, 1::2]).T.astype(np.uint8))


def _even(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return np.concatenate((x, np.zeros((len(x), 1))), axis=1) if x.shape[1] % PAIR else x


def _kmeans(x: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS)].copy()
    for _ in range(rounds):
        near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        for j in range(CENTROIDS):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
    return c


def residuals(book: Codebook, vectors: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the codes (``paired``) leave of the vectors: its part along each vector, as a share of it, and the length of the rest."""
    x = _even(vectors)
    m = len(book.centroids)
    one = np.stack((codes // CENTROIDS, codes % CENTROIDS), axis=1).reshape(-1, codes.shape[1])[:m].T
    total, along = np.zeros(len(x)), np.zeros(len(x))
    for s in range(m):
        part = x[:, PAIR * s : PAIR * s + PAIR]
        left = part - book.centroids[s, one[:, s]]
        total += (left**2).sum(axis=1)
        along += (left * part).sum(axis=1)
    norm = np.maximum((x**2).sum(axis=1), 1e-300)
    return along / norm, np.sqrt(np.maximum(total - along**2 / norm, 0.0))


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed from the first component to the last."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


def scan(book: Codebook, queries: np.ndarray, vectors: np.ndarray, codes: np.ndarray, keep: int, sure: float = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query the ``keep`` vectors of largest inner product: query, vector, score; and how many were scored exactly."""
    index = codes.astype(np.intp)
    vectors = np.asarray(vectors, np.float64)
    n = len(vectors)
    keep = min(keep, n)
    most = min(FIRST * keep, n)
    share, across = residuals(book, vectors, codes)
    # a query's product with a vector is its product with the code and the rest, over what the code has of the vector
    scale = np.where(share < 0.9, 1 / (1 - np.minimum(share, 0.9)), np.nan)
    slack = scale * (sure * across / np.sqrt(max(1, book.dim - 1)) + 1e-6 * (len(codes) + 1) * (np.linalg.norm(vectors, axis=1) * (1 + np.abs(share)) + across))
    who, what, scores = [], [], []
    scored = 0
    for at in range(0, len(queries), 64):
        part = np.asarray(queries[at : at + 64], np.float64)
        for i, table in enumerate(book.tables(part)):
            rough = table[0][index[0]]
            for row, code in zip(table[1:], index[1:]):
                rough += row[code]
            rough = rough * scale
            first = np.argpartition(-np.nan_to_num(rough, nan=-np.inf), most - 1)[:most]
            bar = np.partition(products(vectors[first], part[i]), most - keep)[most - keep]
            few = np.flatnonzero(~(rough + np.linalg.norm(part[i]) * slack + 1e-36 < bar) | ~np.isfinite(rough))
            few = np.union1d(few, first)
            exact = products(vectors[few], part[i])
            best = np.lexsort((few, -exact))[:keep]
            scored += len(few)
            who.append(np.full(len(best), at + i))
            what.append(few[best])
            scores.append(exact[best])
    return np.concatenate(who), np.concatenate(what), np.concatenate(scores), scored


def search(vectors: DataFrame, every: int = 20, k: int = K, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, the ``k`` other rows of largest inner product.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without an id. A product
    needs equal lengths, so rows meet those of their own length, each length with its own codebook (128 bytes a component).
    Rows that share an id are rows like any other: each is asked for itself, and found itself. Ties go to the smaller
    vec_id. A query without other rows, and an empty table, give no rows.
    """
    spark = vectors.sparkSession
    raw = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    fine = raw.where("vec_id is not null and v is not null and forall(v, x -> coalesce(abs(x) < double('infinity'), false)) and exists(v, x -> x <> 0)")
    fine = stored(fine.select("vec_id", "v", F.size("v").alias("d"), F.xxhash64("v").alias("key")), "vectors")
    lengths = fine.groupBy("d").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"))
    at_least = lambda least, n, size: F.greatest(F.lit(least), F.ceil(F.col(n) / size)).cast("int")
    lengths = stored(lengths.select("d", at_least(BLOCKS, "n", BLOCK_ROWS).alias("blocks"), at_least(1, "asked", QUERY_ROWS).alias("turns")), "lengths")
    same = Window.partitionBy("d", "key", "v").orderBy("vec_id")
    classes = fine.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).groupBy("d", "key", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # a class is known by its least id and its key, as rows that share an id may differ
    classes = stored(classes.select("d", F.col("ids")[0].alias("low"), "key", "v", "ids"), "classes")
    held = spark.sparkContext.broadcast(_codebooks(classes))

    def code(batches):
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                packed = np.ascontiguousarray(paired(held.value[d].encode(np.asarray(part.column(3).flatten()).reshape(-1, d))).T)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in packed], pa.binary())], ["d", "low", "key", "v", "code"])

    index = stored(classes.select("d", "low", "key", "v").mapInArrow(code, "d int, low long, key long, v array<double>, code binary"), "index")
    spot = lambda name, count: F.pmod(F.xxhash64(name, "key"), F.col(count)).cast("int")
    count_up = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    # rows of one id and vector have the same answers
    asked = fine.where(F.col("vec_id") % every == 0).groupBy("d", "key", "v", F.col("vec_id").alias("query_id")).agg(F.count("*").alias("times"))
    left = index.join(lengths, "d").select("d", "low", "key", "v", "code", spot("low", "blocks").alias("block"), count_up("turns").alias("turn"))
    right = asked.join(lengths, "d").select("d", "query_id", F.col("key").alias("own"), "times", "v", spot("query_id", "turns").alias("turn"), count_up("blocks").alias("block"))

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "own", "times", "low", "key", "score"]
        if not rows.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5 + [pa.array([], pa.float64())], names)
        d = rows.column("d")[0].as_py()
        matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten()).reshape(-1, d)
        low, key = rows.column("low").to_numpy(), rows.column("key").to_numpy()
        order = np.lexsort((key, low))
        codes = np.stack([np.frombuffer(c, np.uint8) for c in rows.column("code").to_pylist()])[order].T
        who, what, scores, _ = scan(held.value[d], matrix(queries), matrix(rows)[order], np.ascontiguousarray(codes), k + 1, sure)
        asking = [pa.array(queries.column(c).to_numpy()[who]) for c in names[:3]]
        return pa.table([*asking, pa.array(low[order][what]), pa.array(key[order][what]), pa.array(scores)], names)

    near = left.groupBy("d", "block", "turn").cogroup(right.groupBy("d", "block", "turn")).applyInArrow(meet, "query_id long, own long, times long, low long, key long, score double")
    first = Window.partitionBy("query_id", "own").orderBy(F.col("score").desc(), "low", "key")
    best = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n")
    # of the query's own class the query itself is left out, once
    place = F.when(F.col("own") == F.col("key"), F.array_position("ids", F.col("query_id"))).otherwise(0)
    others = F.filter("ids", lambda _, i: i + 1 != place)
    each = best.join(classes.select("low", "key", "ids"), ["low", "key"]).select("query_id", "own", "times", F.explode(others).alias("vec_id"), "score")
    last = Window.partitionBy("query_id", "own").orderBy(F.col("score").desc(), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(last).cast("int")).where(F.col("rank") <= k)
    return ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("query_id", "rank", "vec_id", "score")


def _codebooks(classes: DataFrame) -> dict[int, Codebook]:
    """A codebook for each length of vector, fitted on SAMPLE vectors of it at most, those of the least hashes."""
    share = F.pmod(F.xxhash64("low", "key"), F.lit(1 << 30))
    counts = classes.groupBy("d").agg(F.count("*").alias("n"))
    # a few times the sample is kept before it is sorted
    few = classes.join(counts, "d").where(share <= 4.0 * SAMPLE / F.col("n") * (1 << 30)).select("d", "low", "key", "v")
    lowest = Window.partitionBy("d").orderBy(F.xxhash64("low", "key"), "low", "key")
    sample = few.withColumn("r", F.row_number().over(lowest)).where(F.col("r") <= SAMPLE)

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("r")
        d = rows.column("d")[0].as_py()
        book = Codebook(np.asarray(rows.column("v").combine_chunks().flatten()).reshape(-1, d))
        return pa.table([pa.array([d], pa.int32()), pa.array([pickle.dumps(book)], pa.binary())], ["d", "book"])

    return {r["d"]: pickle.loads(r["book"]) for r in sample.groupBy("d").applyInArrow(fit, "d int, book binary").toLocalIterator()}
