"""Whitening of vectors on an integer lattice, with moments merged pairwise.

Each partition of the fit list (the distinct lattice vectors) gives its count, sums, local mean and centred scatter;
``treeReduce`` merges them two at a time by Chan's formula, so nothing is ever multiplied before it is centred. The driver
decomposes one covariance of dimensions times dimensions. A second pass over the fit list takes the whitened vectors'
covariance in the same way and gives its distance from the identity. The third pass projects the rows.

Rows whose vector is null or holds null or non-finite entries are left out; all others are kept, repeated ids and null ids
too. Vectors of different lengths have no common covariance: each length is a fit of its own, with its own ``n``. An empty
vector has no component, so it gives no row. Components without variance (an eigenvalue under ``LEAST`` of the trace)
can't be scaled to 1 and are left out; so a single distinct vector gives no rows, nor does an empty table. Columns other
than the id and the vector are ignored. Entries beyond 2**46, and deviations that don't fit in a long, raise an error.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Least eigenvalue of a component, as a share of the trace.
LEAST = 1e-12
#: Entries that are worked on at a time.
ENTRIES = 1 << 21

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

#: count, sums, mean and centred scatter of some vectors of one length
Moments = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def lattice(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, x): the usable vectors as longs, x = floor(64 c) + 1000000."""
    own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("c"))
    usable = own.where(F.col("c").isNotNull() & ~F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    fits = F.when(F.exists("c", lambda v: F.abs(v) > 2.0**46), F.raise_error(F.lit("an entry is too large for the lattice"))).otherwise(F.col("c"))
    return usable.select("vec_id", F.transform(fits, lambda v: F.floor(v * SCALE) + F.lit(OFFSET).cast("long")).alias("x"))


def moments(block: np.ndarray) -> Moments:
    """Of the rows of a matrix."""
    n, sums = len(block), block.sum(axis=0)
    mean = sums / n
    centred = block - mean
    return n, sums, mean, centred.T @ centred


def merge(a: Moments, b: Moments) -> Moments:
    """Chan's formula: the scatter of both is the sum of theirs and of what the distance of their means adds."""
    n = a[0] + b[0]
    apart = b[2] - a[2]
    return n, a[1] + b[1], a[2] + apart * (b[0] / n), a[3] + b[3] + np.outer(apart, apart) * (a[0] * (b[0] / n))


def merge_all(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """The same for the moments of several lengths."""
    out = dict(a)
    for length, found in b.items():
        out[length] = merge(out[length], found) if length in out else found
    return out


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix, less OFFSET, of the vectors of each length, some rows at a time."""
    lengths = np.diff(np.asarray(column.offsets))
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(1, ENTRIES // length)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, np.asarray(column.take(pa.array(part)).flatten()).reshape(len(part), length) - OFFSET


def gathered(vectors: DataFrame, seen=None) -> dict[int, Moments]:
    """Moments by length of the matrices of column x, or of what ``seen`` makes of each, merged in a tree."""

    def local(batches):
        found: dict[int, Moments] = {}
        for batch in batches:
            for _, block in _blocks(batch.column(0)):
                length = block.shape[1]
                found = merge_all(found, {length: moments(block if seen is None else seen(block))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["found"])

    parts = vectors.select("x").mapInArrow(local, "found binary").rdd
    return parts.map(lambda row: pickle.loads(row["found"])).treeReduce(merge_all) if parts.getNumPartitions() else {}


class Whitening:
    """The components of one length: n, sums less OFFSET, eigenvectors by column, eigenvalues, and their share of the trace."""

    def __init__(self, found: Moments):
        self.n, self.sums, _, scatter = found
        covariance = scatter / self.n
        values, vectors = np.linalg.eigh(covariance)
        trace = float(np.trace(covariance))
        order = np.argsort(-values, kind="stable")[:COMPONENTS]
        order = order[values[order] > LEAST * trace]
        self.values, vectors = values[order], vectors[:, order]
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
        self.vectors = vectors * signs
        self.explained = self.values / trace if len(order) else self.values
        self.identity_error = 0.0

    def deviations(self, block: np.ndarray) -> np.ndarray:
        """n x - S for each entry, as longs."""
        if self.n * float(np.abs(block).max(initial=0)) + float(np.abs(self.sums).max(initial=0)) >= 2.0**62:
            raise OverflowError("deviations don't fit in a long")
        return block * self.n - self.sums

    def __call__(self, block: np.ndarray) -> np.ndarray:
        return (self.deviations(block) / self.n) @ self.vectors / np.sqrt(self.values)


def fit(points: DataFrame) -> dict[int, Whitening]:
    """The whitening of each length, from a fit list with column x; verified by a second pass over the list."""
    models = {length: Whitening(found) for length, found in gathered(points).items()}
    models = {length: model for length, model in models.items() if len(model.values)}
    usable = points.where(F.size("x").isin(list(models))) if models else points.limit(0)
    again = gathered(usable, lambda block: models[block.shape[1]](block))
    for length, (n, _, _, scatter) in again.items():
        models[length].identity_error = float(np.abs(scatter / n - np.eye(len(scatter))).max())
    return models


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each usable row's whitened components."""
    rows = lattice(vectors, id_column, vector_column)
    models = fit(stored(rows.select("x").distinct(), "whitening"))

    def project(batches):
        for batch in batches:
            ids = batch.column(0)
            for part, block in _blocks(batch.column(1)):
                model = models.get(block.shape[1])
                if model is None:
                    continue
                apart = model.deviations(block)
                if len(part) and float((apart.astype(np.float64) ** 2).sum(axis=1).max()) >= 2.0**63 * (1 - 1e-9):
                    raise OverflowError("deviations don't fit in a long")
                k = len(model.values)
                many = [
                    ids.take(pa.array(np.repeat(part, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                    pa.array(np.full(k * len(part), model.n, np.int64)),
                    pa.array(np.repeat((apart * apart).sum(axis=1), k)),
                    pa.array(model(block).ravel()),
                    pa.array(np.tile(model.explained, len(part))),
                    pa.array(np.full(k * len(part), model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(many, [x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(project, SCHEMA)
