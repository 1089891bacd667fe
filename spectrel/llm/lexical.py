"""Ranked lexical search: postings compressed by shard, read document at a time by a heap of cursors.

**Index.** A task cuts its documents into shards of at most ``SHARD_BYTES`` of text or ``SHARD_ROWS`` rows. Within a shard
documents are numbered in ascending order of their id, and each term has its postings in that order: gaps and frequencies
as variable-length bytes, in blocks of ``BLOCK``. The index is a table of one row a term and shard, and one row a shard
with the documents' ids and lengths, written to the shared folder; a lost task writes its shards again.

**Search.** Terms of the items are joined with the index, which gives their document frequencies and weights. Items are
dealt into groups of about ``ITEMS``; for each group and shard a task gets the postings of the group's terms, decodes
each block once, and for each item merges the terms' cursors: a heap yields the cursor whose block ends first, all
postings up to that document are summed, so these documents are complete, and go to a bounded heap keyed by score and
then id. The best of all shards are merged in two steps, each with Spark's own limit before the shuffle.

Every row of the documents is a document of its own, also where ids repeat (equal scores and ids: in no given order) or
are null (after all others of the same score). Rows of items that share an id (null ids too) are one item of all their
terms. A null or empty text has no term; such items and documents give no row, and an empty table gives none. A text of
any length is hashed in pieces cut between terms. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_hashes

SHARD_BYTES, SHARD_ROWS = 1 << 23, 1 << 16
#: Postings of a block.
BLOCK = 4096
#: Items of a group, about.
ITEMS = 256
#: Bytes that are hashed at a time, but for longer single terms.
PIECE = 1 << 20
#: Shards of an item that are merged first, one step before all.
FANS = 64

#: The bytes of terms; A-Z become a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, np.uint8)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = 1
_TERM[128:] = 1
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_INDEX = "shard long, term string, df long, blocks array<binary>, ids array<long>, lengths array<long>"


# ---------------------------------------------------------------- compression


def to_bytes(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of whole numbers, seven bits each; and where they end for values[:end], for each of ``ends``."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    more = values >> np.uint64(7)
    while more.any():
        size += more > 0
        more >>= np.uint64(7)
    stop = np.cumsum(size)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    at, step = stop - size, 0
    rows = np.arange(len(values))
    while len(rows):
        last = size[rows] == step + 1
        out[at[rows] + step] = ((values[rows] >> np.uint64(7 * step)) & np.uint64(127)).astype(np.uint8) | np.where(last, 0, 128).astype(np.uint8)
        rows, step = rows[~last], step + 1
    return out, np.concatenate(([0], stop))[ends]


def from_bytes(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def decoded(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and frequencies of a block."""
    values = from_bytes(block)
    return np.cumsum(values[0::2]) - 1, values[1::2]


# ---------------------------------------------------------------- index


def _text_pieces(raw: bytes) -> Iterator[np.ndarray]:
    """A text's bytes in lower case, in pieces that end between terms."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw):
            ahead = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - end), end)
            gap = np.flatnonzero(_TERM[ahead] == 0)
            if len(gap):
                end += int(gap[0])
                break
            end += len(ahead)
        yield _LOWER[np.frombuffer(raw, np.uint8, end - at, at)]
        at = end


class _Shard:
    """Documents of a shard while they come in."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.bytes = 0
        self.seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # documents, hashes, frequencies
        self.terms: dict[int, bytes] = {}
        self.texts: list[tuple[int, np.ndarray]] = []  # not hashed so far
        self.held = 0

    def add(self, doc, text: str | None) -> None:
        raw = (text or "").encode("utf-8", "surrogatepass")
        number = len(self.ids)
        self.ids.append(doc)
        self.lengths.append(0)
        self.bytes += len(raw)
        for piece in _text_pieces(raw):
            self.texts.append((number, piece))
            self.held += len(piece)
            if self.held >= PIECE:
                self.flush()

    def flush(self) -> None:
        """Hash the texts held, and count terms by document."""
        if not self.texts:
            return
        gap = np.zeros(1, np.uint8)
        sizes = np.fromiter((len(p) + 1 for _, p in self.texts), np.int64, len(self.texts))
        buf = np.concatenate([x for _, piece in self.texts for x in (piece, gap)])
        numbers = np.fromiter((n for n, _ in self.texts), np.int64, len(self.texts))
        self.texts, self.held = [], 0
        starts, ends, hashes = word_hashes(buf, _TERM)
        if not len(starts):
            return
        docs = numbers[np.searchsorted(np.cumsum(sizes), starts, side="right")]
        order = np.lexsort((hashes, docs))
        docs, hashes = docs[order], hashes[order]
        new = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1]))))
        many = np.diff(new, append=len(docs))
        self.seen.append((docs[new], hashes[new], many))
        for doc, n in zip(*np.unique(docs, return_counts=True)):
            self.lengths[doc] += int(n)
        kinds, at = np.unique(hashes, return_index=True)
        for h, i in zip(kinds.tolist(), order[at].tolist()):
            if h not in self.terms:
                self.terms[h] = buf[starts[i] : ends[i]].tobytes()

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        self.flush()
        # null ids come last; rows of one id stay in their order
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids = pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64()))
        lengths = pa.array([[self.lengths[i] for i in order]], pa.list_(pa.int64()))
        none = pa.nulls(1, pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), none, ids, lengths], _names(_INDEX))
        if not self.seen:
            return
        docs, hashes, many = (np.concatenate(x) for x in zip(*self.seen))
        docs = place[docs]
        order = np.lexsort((docs, hashes))
        docs, hashes, many = docs[order], hashes[order], many[order]
        # a document hashed in pieces may have a term several times
        new = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1]))))
        docs, hashes, many = docs[new], hashes[new], np.add.reduceat(many, new)
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        df = np.diff(first, append=len(docs))
        # blocks: of each term's postings, BLOCK at a time; a block's first gap counts from the shard's first document
        blocks = -(-df // BLOCK)
        begin = np.repeat(first, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        gaps = np.diff(docs, prepend=-1)
        gaps[begin] = docs[begin] + 1
        values = np.empty(2 * len(docs), np.int64)
        values[0::2], values[1::2] = gaps, many
        data, ends = to_bytes(values, 2 * np.append(begin, len(docs)))
        binary = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(blocks))), pa.int32()), binary)
        terms = pa.array([self.terms[h] for h in hashes[first].tolist()], pa.binary()).cast(pa.string())
        n = len(first)
        found = [pa.array(np.full(n, shard)), terms, pa.array(df), lists, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(found, _names(_INDEX))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def build(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index: a row a term and shard (term, df, blocks), and a row a shard (ids and lengths of its documents; no term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc, text.as_py())
                if shard.bytes >= SHARD_BYTES or len(shard.ids) >= SHARD_ROWS:
                    yield from shard.rows(number)
                    shard, number = _Shard(), number + 1
        if shard.ids:
            yield from shard.rows(number)

    own = docs.select(docs[f"`{id_column}`"].cast("long").alias("id"), docs[f"`{text_column}`"].cast("string").alias("text"))
    return stored(own.mapInArrow(run, _INDEX), "postings")


# ---------------------------------------------------------------- search


def lengths_of(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents of n terms each: 100 - 90 + 90 n N / L in whole numbers."""
    if 90 * int(n.max(initial=0)) * documents < 2**63:
        return 10 + 90 * n * documents // max(terms, 1)
    return np.array([10 + 90 * int(x) * documents // terms for x in n], np.int64)


class Cursor:
    """The postings of one term in a shard, as documents and scores, block by block."""

    def __init__(self, weight: int, blocks: list[bytes], m: np.ndarray):
        self.weight, self.blocks, self.m = weight, blocks, m
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Decoded once, for all items that have the term."""
        if i not in self.known:
            docs, tf = decoded(self.blocks[i])
            self.known[i] = docs, self.weight * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[docs]))
        return self.known[i]


def best(cursors: list[Cursor], size: int, k: int) -> list[tuple[int, int]]:
    """(score, document number) of the k best of ``size`` documents, best first, equal scores by number."""
    at = [[c, 0, 0, *c.block(0)] for c in cursors]  # cursor, block, position in it, its documents and scores
    # cursors that have further blocks, by the last document of the block they are in
    heap = [(int(x[3][-1]), i) for i, x in enumerate(at) if len(x[0].blocks) > 1]
    heapq.heapify(heap)
    kept: list[tuple[int, int]] = []  # a heap of (score, -number)
    low = 0
    while low < size:
        high = heap[0][0] if heap else size - 1
        total = np.zeros(high - low + 1, np.int64)
        for x in at:
            docs, scores, pos = x[3], x[4], x[2]
            end = pos + int(np.searchsorted(docs[pos:], high, side="right"))
            total[docs[pos:end] - low] += scores[pos:end]
            x[2] = end
        bar = kept[0][0] if len(kept) == k else 0
        better = np.flatnonzero(total > bar)
        if len(better) > k:
            least = np.partition(total[better], -k)[-k]
            above, same = better[total[better] > least], better[total[better] == least]
            better = np.concatenate((above, same[: k - len(above)]))
        for i in np.sort(better).tolist():
            entry = (int(total[i]), -(low + i))
            if len(kept) < k:
                heapq.heappush(kept, entry)
            elif entry > kept[0]:
                heapq.heapreplace(kept, entry)
        while heap and heap[0][0] == high:
            _, i = heapq.heappop(heap)
            x = at[i]
            x[1:] = [x[1] + 1, 0, *x[0].block(x[1] + 1)]
            if x[1] + 1 < len(x[0].blocks):
                heapq.heappush(heap, (int(x[3][-1]), i))
        low = high + 1
    return [(score, -number) for score, number in sorted(kept, reverse=True)]


def search(index: DataFrame, items: DataFrame, k: int = 10, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    shards = index.where("term is null").select("shard", "ids", "lengths")
    postings = index.where("term is not null").select("shard", "term", "df", "blocks")
    size = shards.select(F.size(F.filter("lengths", lambda x: x > 0)).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("terms"))
    documents, total = size.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    lower = F.translate(items[f"`{text_column}`"].cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = items.select(items[f"`{id_column}`"].alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(f"({TERMS})"), F.lit(1))).alias("term")).distinct()
    groups = -(-own.select("item_id").distinct().count() // ITEMS) or 1
    own = stored(own.withColumn("group", F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int")), "terms")

    frequency = postings.select("term", "df").join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = frequency.select("term", weight.alias("weight")).where("weight > 0")
    wanted = own.join(weights, "term").groupBy("group", "term", "weight").agg(F.collect_list(F.struct("item_id")).alias("items"))
    lists = postings.join(wanted, "term").select("group", "shard", "weight", "items", "blocks", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("lengths"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in lists.dtypes if name in ("weight", "items", "blocks")]
    heads = shards.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "shard", *none, "ids", "lengths")
    kind = items.select(items[f"`{id_column}`"].alias("item_id")).schema["item_id"].dataType
    schema = f"item_id {kind.simpleString()}, shard long, doc_id long, score long"

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["weight", "items", "blocks"]).to_pylist()
        head = next(i for i, row in enumerate(rows) if row["blocks"] is None)
        ids, n = table["ids"][head].as_py(), np.asarray(table["lengths"][head].as_py(), np.int64)
        m = lengths_of(n, documents, total)
        by_item: dict = {}
        for row in rows:
            if row["blocks"] is not None:
                cursor = Cursor(row["weight"], row["blocks"], m)
                for item in row["items"]:
                    by_item.setdefault(item["item_id"], []).append(cursor)
        found = [(item, ids[number], score) for item, cursors in by_item.items() for score, number in best(cursors, len(ids), k)]
        items_, docs_, scores = zip(*found) if found else ((), (), ())
        shard = table["shard"][head].as_py()
        item_type = table.schema.field("items").type.value_type.field("item_id").type
        return pa.table({"item_id": pa.array(items_, item_type), "shard": pa.array([shard] * len(found), pa.int64()), "doc_id": pa.array(docs_, pa.int64()), "score": pa.array(scores, pa.int64())})

    local = lists.unionByName(heads).groupBy("group", "shard").applyInArrow(run, schema)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    fan = F.pmod(F.xxhash64("shard"), F.lit(FANS))
    first = local.withColumn("fan", fan).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "fan").orderBy(*order))).where(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")
