"""Packing by Karmarkar-Karp multiway differencing.

Each task packs the documents of its own input partition, so nothing is shuffled and a lost task is simply run again
(the ids it gives depend on its partition's number and rows only). Whole windows are cut from long documents first; what
remains is gathered into groups of ``GROUP`` windows, and each group's pieces are differenced: the two partial
partitions with the largest imbalance merge with opposing order until one near-equal partition is left. Small pieces that
follow each other go as one, so that a group has few to difference however short its documents are. Is a window then
over capacity, the group gets one window more. The last group of a partition is cut so that what doesn't fill a window
becomes sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches, text_slices
from .tokens import encoder

WINDOW = 2048
#: Windows of a group; differencing costs this times the pieces.
GROUP = 128
#: The remainders are cut into pieces of so many tokens at most: small pieces balance well.
PIECE = 512
#: Pieces that follow each other are differenced as one up to so many tokens: two bundles hold more than this, so a group has at most 2 * GROUP * WINDOW / BUNDLE.
BUNDLE = 256
#: Free tokens a window, within which the imbalance may stay.
SLACK = 3

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp k-way differencing: each piece's window, and the windows' sums."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(k, np.int64)
    left, right = [-1] * n, [-1] * n
    heap = []
    for i, x in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], nodes[0] = x, i
        heap.append((-x if k > 1 else 0, i, sums, nodes))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heapq.heappop(heap)
        nb = nb[::-1]
        sums = sa + sb[::-1]
        nodes = np.maximum(na, nb)
        both = np.flatnonzero((na >= 0) & (nb >= 0))
        if len(both):
            first = len(left)
            left += na[both].tolist()
            right += nb[both].tolist()
            nodes[both] = np.arange(first, first + len(both))
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        turn += 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), turn, sums, nodes))
    _, _, sums, nodes = heap[0]
    window = [-1] * len(left)
    for w, node in enumerate(nodes.tolist()):
        if node >= 0:
            window[node] = w
    for node in range(len(left) - 1, n - 1, -1):
        window[left[node]] = window[right[node]] = window[node]
    return np.asarray(window[:n], np.int64), sums


def bundles(sizes: list[int]) -> tuple[list[int], list[int]]:
    """The bundle of each piece, and the bundles' sizes: pieces in their order, up to BUNDLE together; longer ones alone."""
    bundle, total = [], []
    for n in sizes:
        if not total or total[-1] + n > BUNDLE:
            total.append(0)
        total[-1] += n
        bundle.append(len(total) - 1)
    return bundle, total


class _Packer:
    """Pieces of one partition; ``rows`` holds finished ones."""

    def __init__(self, first_sequence: int):
        self.sequence = first_sequence
        self.rest: list[tuple] = []  # (doc_id, start, ids, doc_tokens), at most PIECE ids each
        self.held = 0
        self.rows: list[tuple] = []

    def emit(self, piece: tuple, sequence: int, offset: int) -> None:
        doc, start, ids, total = piece
        self.rows.append((doc, start, len(ids), zlib.crc32(ids), total, sequence, offset))

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % WINDOW
        for at in range(0, whole, WINDOW):
            self.emit((doc, at, ids[at : at + WINDOW], n), self.sequence, 0)
            self.sequence += 1
        for at in range(whole, n, PIECE):
            self.rest.append((doc, at, ids[at : min(n, at + PIECE)], n))
        self.held += n - whole
        full = GROUP * (WINDOW - SLACK)
        while self.held > full:
            self.group(self.cut(full), GROUP)

    def cut(self, amount: int) -> list[tuple]:
        """The first held pieces of ``amount`` tokens together; the last one may be cut."""
        taken, got = [], 0
        for i, piece in enumerate(self.rest):
            n = len(piece[2])
            if got + n <= amount:
                taken.append(piece)
                got += n
                continue
            doc, start, ids, total = piece
            part = amount - got
            if part:
                taken.append((doc, start, ids[:part], total))
            self.rest = [(doc, start + part, ids[part:], total), *self.rest[i + 1 :]]
            break
        else:
            self.rest = []
        self.held -= amount
        return taken

    def group(self, pieces: list[tuple], k: int) -> None:
        bundle, sizes = bundles([len(p[2]) for p in pieces])
        while True:
            window, sums = difference(sizes, k)
            if not len(sums) or sums.max() <= WINDOW:
                break
            k += 1
        fill = [0] * k
        for piece, b in zip(pieces, bundle):
            w = int(window[b])
            self.emit(piece, self.sequence + w, fill[w])
            fill[w] += len(piece[2])
        self.sequence += k

    def end(self) -> None:
        k = self.held // (WINDOW - SLACK)
        if k:
            self.group(self.cut(k * (WINDOW - SLACK)), k)
        while self.held:
            size = 1 << (self.held.bit_length() - 1)
            offset = 0
            for piece in self.cut(size):
                self.emit(piece, self.sequence, offset)
                offset += len(piece[2])
            self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [()] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents, packed into sequences of at most WINDOW tokens.

    A null text counts as empty (the end id alone). Null and repeated ids are kept as they are: each row is packed.
    An empty table gives no rows; other columns are ignored. A very long text is encoded whole, and its full windows are
    written at once; very many short or empty ones are bundled. ``sequence_id`` holds the input partition's number above
    bit 36 and a running number below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = _Packer(TaskContext.get().partitionId() << 36)
        for batch in batches:
            for lo, hi in text_slices(batch.column(1), 1 << 20):
                part = batch.slice(lo, hi - lo)
                ids, counts = enc.encode(part.column(1).to_pylist(), end_id)
                ids = ids.astype("<u4", copy=False)
                at = 0
                for doc, n in zip(part.column(0).to_pylist(), counts.tolist()):
                    packer.add(doc, ids[at : at + n])
                    at += n
                if packer.rows:
                    yield packer.batch()
        packer.end()
        if packer.rows:
            yield packer.batch()

    small_batches(docs.sparkSession)
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")).mapInArrow(run, SCHEMA)
