"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in d bits share a variant within d/2 flips of each. So every distinct fingerprint emits all
variants within half the radius, the variants are shuffled, and fingerprints that meet at a variant are linked. At most
65 distinct fingerprints lie within one flip of a variant, so no group is large whatever the data; they are linked one
to the next rather than each to each, and each link is verified. Copies share one fingerprint and never meet in a group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import map_slices, stored

SEED = 42
WORDS = 3
RADIUS = 2


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; no words: 0."""
    import xxhash

    if not text:
        return 0
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, found), np.int64, len(found)) + 1
        ends = np.cumsum(size)
        starts = (ends - size)[: len(found) - words + 1].tolist()
        ends = (ends - 1)[words - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist()))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return map_slices(docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")), one, "doc_id long, fp long")


def masks(flips: int) -> list[int]:
    """Signed longs with up to ``flips`` of 64 bits set: 1 + 64 + ... of them, fixed by the radius alone."""
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    return [sum(c) for n in range(flips + 1) for c in combinations(bits, n)]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints (fp long) at ``radius`` or fewer differing bits.

    With an even radius, all that meet at a variant are linked to one another, so a chain in the order of the
    fingerprints loses no connection.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    ball = F.array(*[F.lit(m) for m in masks(radius // 2)])
    met = prints.select("fp", F.explode(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    w = Window.partitionBy("variant").orderBy("fp")
    pairs = met.select("fp", F.lag("fp").over(w).alias("other")).where("other is not null")
    near = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
    return near.select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give repeated rows. Rows are linked
    by their fingerprints alone, so rows of one doc_id with different texts are in components of their own, and rows
    without an id link like others; a null doc_id is never a component's id, and where no row of a component has one, the
    component is null. Texts are read whole, whatever their length; other columns are ignored.
    """
    each = stored(fingerprints(docs, id_column, text_column, words), "fingerprints")
    classes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    found = components(links(classes.select("fp"), radius))
    named = stored(classes.join(found, classes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("c")), "named")
    lowest = named.groupBy("c").agg(F.min("low").alias("component_id"))
    result = named.join(lowest, "c").select("fp", "component_id")
    return each.join(result, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
