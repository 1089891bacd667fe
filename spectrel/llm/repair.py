"""Token ids in files of Re-Pair blocks.

Re-Pair replaces frequent pairs of neighbouring ids by a new symbol, again and again, until no pair occurs often enough to
pay for its rule. Here a round counts all pairs and replaces those above a threshold at once, the more frequent first where
they overlap, X. A block keeps its rules, the number of ids that each rule
stands for, the remaining symbols and the documents' counts, so any range of ids can be decoded alone: the expansion
lengths say where it lies among the symbols.

Blocks are rows of Parquet files: Spark's committer then writes each file once, whatever executors are lost, to any
store that Spark can reach.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, small_batches, text_slices
from .tokens import encoder, spread

MAGIC = b"RPB2"
_HEADER = struct.Struct("<4sBIIQII")
#: Ids of a block, documents being kept whole.
BLOCK = 1 << 20
#: A pair's rule costs two symbols and a length; from this count on it saves more than that.
LEAST = 4
#: The first rounds replace pairs that occur once in so many ids; all others those that occur LEAST times.
ROUNDS = (500, 2_000, 8_000, 32_000)
#: Shards: documents of each, about, and their number at most (the table of their sizes is broadcast).
SHARD_ROWS, MAX_SHARDS = 20_000, 65_536

#: Buckets of pairs: many where rare pairs are asked for, and few, which stay in the processor's cache, where frequent ones are.
_HASH_BITS, _FEW_BITS, _FREQUENT = 19, 16, 100
_NO_PAIR = np.iinfo(np.int32).max
#: So few places are sorted without buckets.
_SHORT = 1 << 16


def _counted(seq: np.ndarray, place: np.ndarray | None, bits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs at ``place`` (None: everywhere) those that occur ``least`` times or more without overlap, as one number; their counts; and where each begins: place, pair."""
    if place is None or len(place) > _SHORT:
        # a bucket's count is no less than that of any pair in it, so only pairs of full buckets are counted one by one
        left, right = (seq[:-1], seq[1:]) if place is None else (seq[place], seq[place + 1])
        hash_bits = _FEW_BITS if least > _FREQUENT else _HASH_BITS
        bucket = ((left * np.uint32(2654435769) + right * np.uint32(2246822519)) >> np.uint32(32 - hash_bits)).astype(np.intp)
        full = np.flatnonzero((np.bincount(bucket, minlength=1 << hash_bits) >= least)[bucket])
        place = full if place is None else place[full]
    key = seq[place].astype(np.uint64) << np.uint64(bits) | seq[place + 1]
    again = np.flatnonzero((key[1:] == key[:-1]) & (place[1:] == place[:-1] + 1)) + 1
    if len(again):
        # of a run of one symbol every other place counts
        first = np.ones(len(key), bool)
        first[again] = False
        turn = np.arange(len(key)) - np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        place, key = place[turn % 2 == 0], key[turn % 2 == 0]
    low = len(seq).bit_length()
    if 2 * bits + low <= 64:
        both = np.sort(key << np.uint64(low) | place.astype(np.uint64))
        key, place = both >> np.uint64(low), (both & np.uint64((1 << low) - 1)).astype(np.int64)
    else:
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(edge, append=len(key))
    often = count >= least
    which = np.repeat(np.where(often, np.cumsum(often) - 1, -1), count)
    return key[edge[often]], count[often], place[which >= 0], which[which >= 0]


def compress(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (n x 2), their expansion lengths, and the remaining symbols. Symbols from ``base`` on are rules.

    No two neighbouring remaining symbols occur together ``least`` times or more, overlaps aside.
    """
    seq = ids.astype(np.uint32)
    bits = (base + len(seq)).bit_length()
    rules: list[np.ndarray] = []
    lengths = np.ones(base, np.int64)
    limits = [max(least, len(seq) // per) for per in ROUNDS] + [least]
    # made once, and set back after each round: the rank of the pair that begins before each place, and the places to ask next
    at, ask, stays = np.full(len(seq) + 2, _NO_PAIR, np.int32), np.zeros(len(seq) + 1, bool), np.ones(len(seq), bool)
    place = None if len(seq) > 1 else np.zeros(0, np.int64)
    while place is None or len(place):
        limit = limits.pop(0) if limits else least
        pairs, count, place, which = _counted(seq, place, bits, limit)
        if not len(pairs):
            if not limits:
                break
            place = None
            continue
        # a pair is replaced where none of the overlapping ones is more frequent
        rank = np.empty(len(pairs), np.int32)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(pairs), dtype=np.int32)
        mine = rank[which]
        at[place + 1] = mine
        best = (mine < at[place]) & (mine < at[place + 2])
        at[place + 1] = _NO_PAIR
        worth = np.bincount(which[best], minlength=len(pairs)) >= least
        best &= worth[which]
        chosen, where = np.flatnonzero(worth), place[best]
        made = np.stack((pairs[chosen] >> np.uint64(bits), pairs[chosen] & np.uint64((1 << bits) - 1)), axis=1).astype(np.int64)
        seq[where] = (len(lengths) + np.cumsum(worth) - 1)[which[best]]
        lengths = np.concatenate((lengths, lengths[made].sum(axis=1)))
        rules.append(made)
        if limits:
            stays[where + 1] = False
            seq, place = seq[stays[: len(seq)]], None if len(seq) - len(where) > 1 else np.zeros(0, np.int64)
            stays[where + 1] = True
            continue
        # only pairs with a new symbol, or of those that stood back, can be frequent now; before a new symbol may stand
        # another one, whose second half is gone
        asked = np.concatenate((place[~best], where, np.maximum(where, 1) - 1, np.maximum(where, 2) - 2))
        stays[where + 1] = False
        if len(asked) > _SHORT:
            ask[asked] = True
            next_place = np.flatnonzero(ask[: len(seq)][stays[: len(seq)]])
            ask[asked] = False
        else:
            asked = np.unique(asked[stays[asked]])
            next_place = asked - np.searchsorted(np.sort(where), asked)
        seq = seq[stays[: len(seq)]]
        stays[where + 1] = True
        place = next_place[next_place < len(seq) - 1]
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return table, lengths[base:], seq


def _pack(symbols: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of all symbols, and each higher bit of all of them."""
    return symbols.astype("<u2").tobytes() + b"".join(np.packbits((symbols >> np.uint32(i)) & np.uint32(1)).tobytes() for i in range(16, bits))


def encode_block(ids: np.ndarray, counts: np.ndarray, doc_ids: list, base: int) -> bytes:
    rules, lengths, seq = compress(ids, base)
    bits = max(16, int(base + len(rules) - 1).bit_length())
    known = np.array([x is not None for x in doc_ids], bool)
    values = np.array([0 if x is None else x for x in doc_ids], "<i8")
    header = _HEADER.pack(MAGIC, bits, base, len(doc_ids), len(ids), len(rules), len(seq))
    return b"".join((header, values.tobytes(), np.packbits(known).tobytes(), counts.astype("<u4").tobytes(), _pack(rules.reshape(-1).astype(np.uint32), bits), lengths.astype("<u4").tobytes(), _pack(seq, bits)))


class Block:
    """A block read back; ``ids(lo, hi)`` decodes just that range."""

    def __init__(self, data: bytes):
        magic, bits, self.base, docs, self.n, rules, symbols = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair block")
        at = _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        def unpack(n: int) -> np.ndarray:
            out = take("<u2", n).astype(np.int64)
            for i in range(16, bits):
                out |= np.unpackbits(take("u1", (n + 7) // 8), count=n).astype(np.int64) << i
            return out

        values = take("<i8", docs)
        known = np.unpackbits(take("u1", (docs + 7) // 8), count=docs)
        self.doc_ids = [v if k else None for v, k in zip(values.tolist(), known.tolist())]
        self.counts = take("<u4", docs).astype(np.int64)
        self.rules = unpack(2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules).astype(np.int64)
        self.symbols = unpack(symbols)
        self._table: tuple | None = None
        self._ends: np.ndarray | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all symbols one after another, and where each symbol's begin. Rules only name earlier symbols."""
        if self._table is None:
            starts = np.concatenate((np.arange(self.base), self.base + np.cumsum(self.lengths) - self.lengths))
            flat = np.zeros(self.base + int(self.lengths.sum()), np.uint32)
            flat[: self.base] = np.arange(self.base)
            sizes = np.concatenate((np.ones(self.base, np.int64), self.lengths))
            done = 0
            while done < len(self.rules):
                # as many rules as name only what is expanded already
                late = np.flatnonzero(self.rules[done:].max(axis=1) >= self.base + done)
                end = done + int(late[0]) if len(late) else len(self.rules)
                part = self.rules[done:end].reshape(-1)
                out = spread(flat, starts[part], sizes[part])
                at = starts[self.base + done]
                flat[at : at + len(out)] = out
                done = end
            self._table = flat, starts, sizes
        return self._table

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        flat, starts, sizes = self._expansions()
        if lo == 0 and hi is None:
            return spread(flat, starts[self.symbols], sizes[self.symbols])
        if self._ends is None:
            self._ends = np.cumsum(sizes[self.symbols])
        a = int(np.searchsorted(self._ends, lo, side="right"))
        b = int(np.searchsorted(self._ends, hi, side="left")) + 1
        before = int(self._ends[a - 1]) if a else 0
        part = self.symbols[a:b]
        return spread(flat, starts[part], sizes[part])[lo - before : hi - before]

    def document(self, i: int) -> np.ndarray:
        end = int(self.counts[: i + 1].sum())
        return self.ids(end - int(self.counts[i]), end)


_BLOCK_SCHEMA = "shard int, block int, shard_start long, n_tokens long, data binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the ids in ascending doc_id order.

    Shards are ranges of ids; null ids come first. Rows that share an id follow one another in the order of their texts'
    hashes, and equal rows in any order, so rows of one id may be in several shards. An empty table writes no blocks;
    other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD_ROWS))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    ranged = own.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(min(MAX_SHARDS, shards), *order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        base = len(enc.marks)
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list = []
        size = block = start = 0

        def finish(shard: int) -> pa.RecordBatch:
            nonlocal held, sizes, names, size, block, start
            data = encode_block(np.concatenate(held), np.concatenate(sizes), names, base)
            row = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (block, pa.int32()), (start, pa.int64()), (size, pa.int64()), (data, pa.binary()))], ["shard", "block", "shard_start", "n_tokens", "data"])
            held, sizes, names, block, start, size = [], [], [], block + 1, start + size, 0
            return row

        shard = 0
        for batch in batches:
            shard = batch.column(0)[0].as_py() if batch.num_rows else shard
            for lo, hi in text_slices(batch.column(2)):
                ids, counts = enc.encode(batch.column(2).slice(lo, hi - lo).to_pylist(), end_id)
                if held and size + len(ids) > BLOCK:
                    yield finish(shard)
                held.append(ids)
                sizes.append(counts)
                names += batch.column(1).slice(lo, hi - lo).to_pylist()
                size += len(ids)
        if held:
            yield finish(shard)

    numbered = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    numbered.mapInArrow(blocks, _BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files; start counts all ids before it."""
    files = spark.read.schema(_BLOCK_SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each shard, MAX_SHARDS at most
    first = totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = Block(data.as_buffer())
                raw = memoryview(block.ids().astype("<u4", copy=False)).cast("B")
                ends = np.cumsum(block.counts)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - block.counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids, pa.int64()), pa.array(start + ends - block.counts), pa.array(block.counts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = files.join(F.broadcast(first), "shard").select((F.col("before") + F.col("shard_start")).alias("start"), "data")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = new_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path)
