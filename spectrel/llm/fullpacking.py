"""Packing of whole documents into as few sequences as can be found, by bin completion (``binpacking``).

Documents of up to ``CAPACITY`` tokens stay whole; longer ones are cut into pieces of that many, and the last piece may be
shorter. Three passes, none of which holds more than one slice of texts or one table of lengths:

1. Tasks turn texts into ids and write one row a piece, with the piece's length and its number among its partition's
   pieces of that length.
2. Pieces are counted by partition and length. A running sum over partitions, for each length, makes the numbers global;
   a length that a third of all pieces have is one short row a partition here. The totals, at most CAPACITY numbers, are
   all that the search gets, so it takes as long for 10**12 pieces as for 10**6, and can use pieces of any partition together.
3. The fillings are laid out as ranges of piece numbers for each length (a table bounded by the number of fillings), in
   which every task looks up its pieces' sequence and offset.

A null text counts as empty: the end id alone. Null and repeated ids are kept as they are, each row is packed; an empty
table gives no rows; other columns are ignored. Very long texts are encoded whole, one at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .binpacking import NODES, Filling, pack
from .common import stored, text_slices
from .tokens import encoder

CAPACITY = 4096

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_column: str, text_column: str) -> DataFrame:
    """One row a piece; ``number`` counts the pieces of its length in the partition ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi in text_slices(batch.column(1), 1 << 20):
                rows = batch.slice(lo, hi - lo)
                ids, counts = enc.encode(rows.column(1).to_pylist(), end_id)
                ids = ids.astype("<u4", copy=False)
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                at = (np.cumsum(counts) - counts)[row] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
                # the number of a piece: those of its length before this slice, and before it here
                order = np.argsort(length, kind="stable")
                kinds, first, many = np.unique(length[order], return_index=True, return_counts=True)
                number = np.empty(len(length), np.int64)
                number[order] = np.arange(len(length)) - np.repeat(first, many)
                number += seen[length]
                seen[kinds] += many
                made = [rows.column(0).take(pa.array(row)), piece.astype(np.int32), start, length, crc, np.full(len(row), part, np.int32), number]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types)], _names(_PIECES))

    return docs.select(docs[f"`{id_column}`"].cast("long").alias("doc_id"), docs[f"`{text_column}`"].cast("string").alias("text")).mapInArrow(run, _PIECES)


class Layout:
    """Where the pieces of each length go: ranges of their numbers, each of one filling."""

    def __init__(self, fillings: list[Filling], capacity: int):
        rows = []  # length, first number, pieces a bin, first sequence, first offset
        given = [0] * (capacity + 1)
        self.sequences = 0
        for lengths, bins in fillings:
            offset = 0
            for length, times in lengths:
                rows.append((length, given[length], times, self.sequences, offset))
                given[length] += times * bins
                offset += times * length
            self.sequences += bins
        rows.sort()
        self.table = np.asarray(rows, np.int64).reshape(len(rows), 5)
        self.begins = np.searchsorted(self.table[:, 0], np.arange(capacity + 2))

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of those lengths and numbers."""
        entry = np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            lo, hi = self.begins[n], self.begins[n + 1]
            own = length == n
            entry[own] = lo + np.searchsorted(self.table[lo:hi, 1], number[own], side="right") - 1
        _, first, times, sequence, offset = self.table[entry].T
        after = number - first
        return sequence + after // times, offset + after % times * length


def pack_whole(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", nodes: int = NODES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, sequences, least_sequences): pieces and their places.

    The last two are one value each: the sequences used, and a number that no packing of these pieces can go below.
    """
    pieces = stored(cut(docs, tokenizer, end_id, capacity, id_column, text_column), "pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    totals = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        totals[row["length"]] = row["n"]
    fillings, least = pack(totals, nodes)
    layout = Layout(fillings, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch.column(name)) for name in ("length", "number"))
            sequence, offset = layout.places(length, number)
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in _names(SCHEMA)[:5]), pa.array(sequence), pa.array(offset)], _names(SCHEMA))

    numbered = pieces.join(before, ["part", "length"]).select(*_names(SCHEMA)[:5], (F.col("number") + F.col("before")).alias("number"))
    placed = numbered.mapInArrow(place, SCHEMA)
    return placed.select("*", F.lit(layout.sequences).cast("long").alias("sequences"), F.lit(least).cast("long").alias("least_sequences"))
