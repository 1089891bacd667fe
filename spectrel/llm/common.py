"""What the corpus operators share: tables in the shared folder, Arrow helpers and hashing of bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import new_path, shared_dir, stored

#: Texts are taken in slices of about so many bytes, so that the work arrays of a task stay small.
SLICE_BYTES = 1 << 18


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 texts instead of Spark's 10,000, unless the session has its own number (texts may be long)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def whole_rows(df: DataFrame) -> Column:
    """All columns of ``df`` as one, so that names of an operator's own can't clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("whole")


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of an Arrow string column, each of about ``limit`` bytes, one row at least."""
    n = len(texts)
    if not n:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    ends = np.cumsum(lengths)
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def map_slices(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Apply ``f`` to slices of about ``limit`` bytes of ``text``."""

    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi in text_slices(batch.column(text), limit):
                out = f(batch.slice(lo, hi - lo))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def packed_bytes(texts: pa.Array, gap: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One uint8 buffer of all texts (null: empty), each followed by ``gap`` spaces; starts and lengths in bytes."""
    parts = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in texts.to_pylist()]
    lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    buf = np.frombuffer((b" " * gap).join(parts) + b" " * gap, np.uint8)
    starts = np.zeros(len(parts), np.int64)
    np.cumsum(lengths[:-1] + gap, out=starts[1:])
    return buf, starts, lengths


def _tables() -> tuple[np.ndarray, np.uint64, np.uint64]:
    rng = np.random.default_rng(20240229)
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    return values, base, np.uint64(pow(int(base), -1, 2**64))


BYTE_VALUES, BASE, BASE_INVERSE = _tables()


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0x7FB5D329728EA185)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def word_hashes(buf: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the maximal runs of equal non-zero class in a byte buffer.

    ``keep``: for each byte value its class; 0 separates words, and a change of class starts a new word.
    """
    kind = keep[buf]
    change = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    ends = np.append(change[1:], len(buf))
    real = kind[change] > 0
    starts, ends = change[real], ends[real]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[buf] * powers(BASE, len(buf)), out=total[1:])
        h = (total[ends] - total[starts]) * powers(BASE_INVERSE, len(buf))[starts]
        return starts, ends, mixed(h + (ends - starts).astype(np.uint64))


#: A Bloom filter is made in so many pieces, each by one task; a key's lowest bits name its piece (keys may be
#: least hashes, whose upper bits are all alike).
PIECES = 16


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a filter of ``bits`` bits, both in the piece of the key."""
    size = bits // PIECES
    first = (h & np.uint64(PIECES - 1)) * np.uint64(size)
    h = mixed(h)
    return first + (h & np.uint64(size - 1)), first + ((h >> np.uint64(32)) & np.uint64(size - 1))


def bloom_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of a long column of hashes, of ``bits`` bits (a power of two) whatever the data; it may let others pass, and drops none."""
    size = bits // PIECES // 8

    def build(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            h = np.asarray(batch.column(0)).view(np.uint64)
            which = (h & np.uint64(PIECES - 1)).astype(np.int64)
            for piece in np.unique(which).tolist():
                table = tables.setdefault(piece, np.zeros(size, np.uint8))
                for probe in _probes(h[which == piece], bits):
                    probe = probe - np.uint64(8 * size * piece)
                    np.bitwise_or.at(table, probe >> np.uint64(3), np.uint8(128) >> (probe & np.uint64(7)).astype(np.uint8))
        if tables:
            yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array([t.tobytes() for t in tables.values()], pa.binary())], ["piece", "bits"])

    key = F.col(keys.columns[0])
    dealt = keys.select(key.alias("key")).repartition(PIECES, key.bitwiseAND(PIECES - 1))
    table = np.zeros(bits // 8, np.uint8)
    for row in dealt.mapInArrow(build, "piece int, bits binary").toLocalIterator():
        table[size * row["piece"] : size * (row["piece"] + 1)] = np.frombuffer(row["bits"], np.uint8)
    return table


def bloom_has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for probe in _probes(h.view(np.uint64), 8 * len(table)):
        out &= (table[probe >> np.uint64(3)] >> (np.uint64(7) - (probe & np.uint64(7))).astype(np.uint8)) & 1 > 0
    return out


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id's text is 2 modulo 4 (null ids: not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


__all__ = ["bloom_filter", "bloom_has", "held_out", "map_slices", "mixed", "new_path", "packed_bytes", "powers", "read_table", "shared_dir", "small_batches", "stored", "text_slices", "whole_rows", "word_hashes"]
