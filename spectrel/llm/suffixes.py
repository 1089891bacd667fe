"""Repeated long strings by a family of suffix arrays.

Every window of LENGTH bytes has an anchor: of its GRAM-byte strings the one with the least hash (of equals the last).
Equal windows have equal anchors at the same place, so only strings around equal anchors can repeat. Neighbouring windows
with one anchor form a run. Anchors that occur once drop out by a count; the runs of the others are dealt by anchor, and
each task keeps them in a logarithmic family of suffix arrays: a batch of runs is sorted, merge-scanned against all
levels for its longest matches to the right of the anchor (and, in a mirrored family, to the left), and levels of about
equal size are merged. A window of j bytes before its anchor repeats if another one has the same j bytes to the left and
the same LENGTH - j to the right: these are neighbours in the two arrays, with common prefixes of no less between them.

Anchors with very many runs don't go to one task: Spark counts their runs, and the windows of runs that occur once, with
sums made before each shuffle. That is the exact way for what a task can't hold; tests hold both ways against brute force.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_VALUES, bloom_filter, bloom_has, mixed, small_batches, stored
from .tokens import spread

LENGTH = 200
GRAM = 32
#: An anchor with more runs than this is counted by Spark instead of one task.
HOT = 2_000
#: Bits of the Bloom filters of repeated and of hot anchors, and of documents with repeats: at most, and for each key.
FILTER_BITS, KEY_BITS = 1 << 28, 12
#: Bytes worked on at a time; long texts are cut into overlapping parts.
PART = 1 << 16
#: Runs worked on at a time.
CHUNK = 3_000
#: Runs of a task, about.
TASK_RUNS = 60_000

#: Windows of a cell, see ``_hot``.
CELL = 8

_WINDOWS = LENGTH - GRAM + 1


def _mod_power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 2**64))


def _hashes(buf: np.ndarray, long: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes of all GRAM-byte and, if asked, of all LENGTH-byte strings of a buffer, by doubling."""
    with np.errstate(over="ignore"):
        h = {1: BYTE_VALUES[buf]}
        size = 1
        needed = (8, 64, 128, GRAM) if long else (GRAM,)
        while size < (128 if long else GRAM):
            a = h[size] if size in needed else h.pop(size)
            h[2 * size] = a[:-size] * _mod_power(size) + a[size:]
            size *= 2
        if not long:
            return h[GRAM], None
        n = len(buf) - LENGTH + 1
        whole = h[128][:n] * _mod_power(72) + h[64][128 : 128 + n] * _mod_power(8) + h[8][192 : 192 + n]
        return h[GRAM], mixed(whole)


def _owners(gram: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` windows the place of its anchor."""
    bits = np.uint64(17)
    place = np.uint64((1 << 17) - 1) - np.arange(len(gram), dtype=np.uint64)
    m = (mixed(gram) >> bits << bits) | place
    size = 1
    while 2 * size <= _WINDOWS:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = _WINDOWS - size
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    return (np.uint64((1 << 17) - 1) - (m[:n] & np.uint64((1 << 17) - 1))).astype(np.int64)


class Runs:
    """Runs of a buffer of texts: anchor key, first window, number of windows, the anchor's place after the first window's start."""

    def __init__(self, data: list[bytes], spans: bool):
        self.buf = np.frombuffer(b"".join(data), np.uint8)
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        self.first = np.cumsum(lengths) - lengths
        n = len(self.buf) - LENGTH + 1
        if n <= 0:
            self.text = self.start = self.count = self.offset = np.zeros(0, np.int64)
            self.key = self.span = np.zeros(0, np.uint64)
            return
        gram, whole = _hashes(self.buf, spans)
        owner = _owners(gram, n)
        text = np.repeat(np.arange(len(data)), lengths)
        inside = np.zeros(n + 1, bool)
        inside[:n] = text[:n] == text[LENGTH - 1 :][:n]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (owner[1:] != owner[:-1]) | (text[1:n] != text[: n - 1]) | ~inside[: n - 1]
        start = np.flatnonzero(new & inside[:n])
        ends = np.flatnonzero(inside[:n] & ~(np.append(~new[1:], False) & inside[1 : n + 1])) + 1
        self.start, self.count = start, ends - start
        self.text = text[start]
        self.offset = owner[start] - start
        self.key = mixed(gram[owner[start]])
        if spans:
            with np.errstate(over="ignore"):
                self.span = mixed(whole[start] * np.uint64(0x9E3779B97F4A7C15) + mixed(whole[ends - 1] + self.count.astype(np.uint64)))

    def bytes_of(self, some: np.ndarray) -> pa.Array:
        sizes = self.count[some] - 1 + LENGTH
        flat = spread(self.buf, self.start[some], sizes)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _parts(texts: list[bytes]):
    """(data, text number, first byte) for groups of texts of about PART bytes; longer texts come in parts that share LENGTH - 1 bytes."""
    data, number, at = [], [], []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for lo in range(0, len(t) - LENGTH + 1, PART):
            piece = t[lo : lo + PART + LENGTH - 1] if len(t) > PART else t
            data.append(piece)
            number.append(i)
            at.append(lo)
            size += len(piece)
            if size >= PART - 4096:
                yield data, np.array(number), np.array(at)
                data, number, at, size = [], [], [], 0
    if data:
        yield data, np.array(number), np.array(at)


class Level:
    def __init__(self, suffixes: np.ndarray, items: np.ndarray):
        self.suffixes, self.items = suffixes, items

    def merged(self, other: Level) -> Level:
        """Both arrays as one, in order; of equals those of ``self`` first."""
        at = np.searchsorted(self.suffixes, other.suffixes, side="right") + np.arange(len(other.items))
        rest = np.ones(len(self.items) + len(other.items), bool)
        rest[at] = False
        suffixes, items = np.empty(len(rest), self.suffixes.dtype), np.empty(len(rest), self.items.dtype)
        for out, own, new in ((suffixes, self.suffixes, other.suffixes), (items, self.items, other.items)):
            out[rest], out[at] = own, new
        return Level(suffixes, items)


class IndexFamily:
    """Suffix arrays of growing size. ``longest[i]``: the longest common prefix of item i with any other item, so far."""

    def __init__(self, width: int):
        self.width = width
        self.levels: list[Level] = []
        self.lengths = np.zeros(0, np.int64)
        self.longest = np.zeros(0, np.int64)

    def _common(self, a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray) -> np.ndarray:
        """Common prefixes of row i of a and row i of b."""
        out = np.zeros(len(a), np.int64)
        for lo in range(0, len(a), 1 << 13):
            x, y = (np.ascontiguousarray(s[lo : lo + (1 << 13)]).view(np.uint8).reshape(-1, self.width + 1)[:, : self.width] for s in (a, b))
            differ = x != y
            out[lo : lo + (1 << 13)] = np.where(differ.any(axis=1), differ.argmax(axis=1), self.width)
        return np.minimum(out, np.minimum(self.lengths[ia], self.lengths[ib]))

    def _match(self, a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray) -> None:
        """Neighbours: row i of a against row i of b."""
        common = self._common(a, ia, b, ib)
        np.maximum.at(self.longest, ia, common)
        np.maximum.at(self.longest, ib, common)

    def add(self, matrix: np.ndarray, lengths: np.ndarray) -> None:
        """A new batch: rows of ``width`` bytes, of which ``lengths`` count (below 256). Zeros fill the rest, so equal rows go by length."""
        first = len(self.lengths)
        self.lengths = np.concatenate((self.lengths, lengths))
        self.longest = np.concatenate((self.longest, np.zeros(len(lengths), np.int64)))
        new = np.concatenate((matrix, lengths[:, None].astype(np.uint8) + np.uint8(1)), axis=1).view(f"S{self.width + 1}").reshape(-1)
        order = np.argsort(new, kind="stable")
        batch = Level(new[order], first + order)
        self._match(batch.suffixes[:-1], batch.items[:-1], batch.suffixes[1:], batch.items[1:])
        for level in self.levels:
            # where the batch's suffixes fall between the level's: only those on both sides of such a gap gain neighbours
            at = np.searchsorted(level.suffixes, batch.suffixes)
            before = np.flatnonzero((at > 0) & np.append(True, at[1:] != at[:-1]))
            self._match(batch.suffixes[before], batch.items[before], level.suffixes[at[before] - 1], level.items[at[before] - 1])
            after = np.flatnonzero((at < len(level.items)) & np.append(at[1:] != at[:-1], True))
            self._match(batch.suffixes[after], batch.items[after], level.suffixes[at[after]], level.items[at[after]])
        while self.levels and len(self.levels[-1].items) <= 2 * len(batch.items):
            batch = self.levels.pop().merged(batch)
        self.levels.append(batch)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Each item's place in one array of all, and the common prefix of each place with the one before it."""
        while len(self.levels) > 1:
            last = self.levels.pop()
            self.levels.append(self.levels.pop().merged(last))
        whole = self.levels[0]
        place = np.empty(len(whole.items), np.int64)
        place[whole.items] = np.arange(len(place))
        common = np.zeros(len(place), np.int64)
        common[1:] = self._common(whole.suffixes[:-1], whole.items[:-1], whole.suffixes[1:], whole.items[1:])
        return place, common


def _matrix(flat: np.ndarray, key: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of the 8 bytes of a key and up to ``width`` bytes of ``flat`` from ``starts`` on, forwards or backwards."""
    out = np.zeros((len(starts), 8 + width), np.uint8)
    out[:, :8] = key.astype(">u8").view(np.uint8).reshape(-1, 8)
    reach = np.arange(width)
    at = starts[:, None] + step * reach
    fits = reach < sizes[:, None]
    out[:, 8:] = np.where(fits, flat[np.where(fits, at, 0)], 0)
    return out


class Matcher:
    """Runs of a task in two families of suffix arrays: of what follows from the anchor on, and of what goes before it, backwards."""

    def __init__(self):
        self.right, self.left = IndexFamily(8 + LENGTH), IndexFamily(8 + _WINDOWS - 1)
        self.columns: list[tuple] = []

    def add(self, key, count, offset, many, flat: np.ndarray, starts: np.ndarray) -> None:
        ahead = np.minimum(count - 1 + LENGTH - offset, LENGTH)
        back = np.minimum(offset, _WINDOWS - 1)
        self.right.add(_matrix(flat, key, starts + offset, ahead, LENGTH, 1), ahead + 8)
        self.left.add(_matrix(flat, key, starts + offset - 1, back, _WINDOWS - 1, -1), back + 8)
        self.columns.append((count, offset, many))

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run number, first window, last window + 1) of all repeated windows, as ranges."""
        if not self.columns:
            return (np.zeros(0, np.int64),) * 3
        count, offset, many = (np.concatenate(x) for x in zip(*self.columns))
        # window w has offset - w bytes before its anchor; both sides must match that far
        lo = np.where(many, 0, np.maximum(0, offset - (self.left.longest - 8)))
        hi = np.where(many, count, np.minimum(count, self.right.longest - 8 - LENGTH + offset + 1))
        (at_left, common_left), (at_right, common_right) = self.left.joined(), self.right.joined()
        hit = np.zeros((len(count), _WINDOWS), bool)
        for j in range(_WINDOWS):
            window = offset - j
            some = np.flatnonzero((window >= lo) & (window < hi))
            if not len(some):
                continue
            # places between which the common prefix is never shorter have the same bytes
            left = np.cumsum(common_left < 8 + j)[at_left[some]]
            right = np.cumsum(common_right < 8 + LENGTH - j)[at_right[some]]
            _, which, times = np.unique(left << 32 | right, return_inverse=True, return_counts=True)
            weight = times + np.bincount(which, many[some] > 0, len(times))
            hit[some, window[some]] = weight[which] > 1
        return _ranges(*np.nonzero(hit))


def _ranges(owner: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    new = np.append(True, (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)) if len(owner) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1 if len(first) else first
    return owner[first], window[first], window[last] + 1


_RUN_SCHEMA = "key long, d long, th long, at long, count int, offset int, span long, many int, data binary"


def repeats(docs: DataFrame, hot: int = HOT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(d, th, lo, hi): byte ranges that repeated windows cover, for texts known by ``d`` and ``th``. ``docs`` has these and text."""
    spark = docs.sparkSession

    def texts_of(batch) -> list[bytes]:
        return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]

    def slices(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                yield batch.slice(lo, 200)

    def count(batches):
        for batch in slices(batches):
            keys = [Runs(data, False).key for data, _, _ in _parts(texts_of(batch))]
            if keys:
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    counted = stored(docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    sizes = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("runs"), F.count("*").alias("keys"), F.count_if(F.col("n") > hot).alias("hot")).first()
    total = sizes["runs"]
    tables = spark.sparkContext.broadcast((bloom_filter(counted.select("key"), _bits(sizes["keys"], filter_bits)), bloom_filter(counted.where(F.col("n") > hot).select("key"), _bits(sizes["hot"], filter_bits))))

    def emit(batches):
        twice, often = tables.value
        for batch in slices(batches):
            d, th = (batch.column(i).to_numpy() for i in (0, 1))
            for data, number, at in _parts(texts_of(batch)):
                runs = Runs(data, True)
                some = np.flatnonzero(bloom_has(twice, runs.key))
                if not len(some):
                    continue
                # equal runs of this part: one stands for all, and all are known to repeat
                _, first, which, times = np.unique(runs.span[some], return_index=True, return_inverse=True, return_counts=True)
                many = np.where(times[which] > 1, 1, 0)
                stands = np.zeros(len(some), bool)
                stands[first] = True
                hot_ = bloom_has(often, runs.key[some])
                # 1: repeats, and stands for others; 2: repeats, no more to be asked; 3 and 4: the same for hot anchors
                kind = np.where(many == 0, np.where(hot_, 3, 0), np.where(stands, np.where(hot_, 4, 1), 2))
                doc = number[runs.text[some]]
                place = at[runs.text[some]] + runs.start[some] - runs.first[runs.text[some]]
                data_ = runs.bytes_of(some[kind != 2])
                index = np.full(len(some), -1)
                index[kind != 2] = np.arange(len(data_))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(runs.key[some].view(np.int64)), pa.array(d[doc]), pa.array(th[doc]), pa.array(place), pa.array(runs.count[some].astype(np.int32)), pa.array(runs.offset[some].astype(np.int32)),
                        pa.array(runs.span[some].view(np.int64)), pa.array(kind.astype(np.int32)), data_.take(pa.array(index, mask=index < 0)),
                    ],
                    ["key", "d", "th", "at", "count", "offset", "span", "many", "data"],
                )

    runs = stored(docs.mapInArrow(emit, _RUN_SCHEMA), "runs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_RUNS))

    def match(batches):
        matcher = Matcher()
        held = []
        for batch in (b.slice(lo, CHUNK) for b in batches for lo in range(0, b.num_rows, CHUNK)):
            key, count_, offset, many = (batch.column(i).to_numpy().astype(t) for i, t in ((0, np.int64), (4, np.int64), (5, np.int64), (7, np.int64)))
            data = batch.column(8)
            starts = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data)].astype(np.int64)
            matcher.add(key.view(np.uint64), count_, offset, many, np.frombuffer(data.buffers()[2], np.uint8), starts)
            held.append([batch.column(i).to_numpy() for i in (1, 2, 3)])
        if not held:
            return
        d, th, at = (np.concatenate(x) for x in zip(*held))
        run, lo, hi = matcher.repeated()
        for i in range(0, len(run), 1 << 14):
            r = run[i : i + (1 << 14)]
            yield _covered(d[r], th[r], at[r] + lo[i : i + (1 << 14)], at[r] + hi[i : i + (1 << 14)] - 1 + LENGTH)

    counted_, few = _hot(runs.where("many in (3, 4)"), hot)
    dealt = runs.where("many in (0, 1)").select(few.columns).unionAll(few).repartition(parts, "key")
    found = dealt.mapInArrow(match, "d long, th long, lo long, hi long")
    known = runs.where("many in (1, 2, 4)").select("d", "th", F.col("at").alias("lo"), (F.col("at") + F.col("count") - 1 + LENGTH).alias("hi"))
    return found.unionAll(known).unionAll(counted_)


def _bits(keys: int, most: int) -> int:
    """Bits of a filter of so many keys: a power of two."""
    return min(most, max(1 << 16, 1 << (KEY_BITS * keys).bit_length()))


def _covered(d, th, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, th, lo, hi)], ["d", "th", "lo", "hi"])


def _place(rows: DataFrame, *keys: str) -> DataFrame:
    """Places of the strings (``keys``) that occur once: their sum of weights is 1, so the least place is the only one."""
    sums = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("d").alias("d"), F.min("th").alias("th"), F.min("at").alias("at"))
    return sums.where("n = 1").select("d", "th", "at")


def _whole(rows: DataFrame, alone: DataFrame) -> DataFrame:
    """What runs that don't stand for others cover, but for those that occur once."""
    known = rows.select("d", "th", "at", "count").join(alone, ["d", "th", "at"], "left_anti")
    return known.select("d", "th", F.col("at").alias("lo"), (F.col("at") + F.col("count") - 1 + LENGTH).alias("hi"))


def _hot(runs: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """Runs of frequent anchors: what is settled by counting, and runs that tasks can compare as they do others.

    Runs whose whole string occurs twice repeat. Copies are summed before the shuffle, and what occurs once is taken away
    by its place, so no step brings the rows of a frequent string together. Of each distinct string one run is left: where
    an anchor has few of them they go to a task; else each is cut by the windows' place into cells of CELL windows.
    A cell repeats as a whole, or has a core (the bytes of all its windows) that occurs once, so that none of its windows
    repeats; of the others each window is counted.
    """
    weighed = runs.withColumn("n", F.when(F.col("many") == 4, 2).otherwise(1))
    alone = stored(_place(weighed, "key", "span"), "alone")
    whole = _whole(runs.where("many = 3"), alone)
    row = F.struct("d", "th", "at", "count", "offset", "data")
    first = stored(weighed.groupBy("key", "span").agg(F.sum("n").alias("n"), F.min_by(row, F.struct("d", "th", "at")).alias("r")).select("key", "span", "n", "r.*"), "strings")
    sizes = first.groupBy("key").agg((F.count("*") <= hot).alias("few"))
    first = stored(first.join(sizes, "key"), "sized")
    few = first.where("few").select("key", "d", "th", "at", "count", "offset", "span", (F.col("n") > 1).cast("int").alias("many"), "data")

    def cells(batches):
        for batch in (b.slice(lo, CHUNK) for b in batches for lo in range(0, b.num_rows, CHUNK)):
            out: list[tuple] = []
            for key, n, d, th, at, count, offset, data in zip(*(batch.column(i).to_pylist() for i in range(8))):
                lo = 0
                while lo < count:
                    cell = (offset - lo) // CELL
                    hi = min(count, offset - cell * CELL + 1)
                    part = data[lo : hi - 1 + LENGTH]
                    # what any window of the cell holds, also where the run ends within the cell
                    middle = data[offset - cell * CELL : offset - cell * CELL + LENGTH - CELL + 1]
                    core, span = (int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in (middle, part))
                    out.append((key, n, d, th, at + lo, hi - lo, cell, core, span, part))
                    lo = hi
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.binary()]
            names = ["key", "n", "d", "th", "at", "count", "cell", "core", "span", "data"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    wide = first.where("not few").select("key", "n", "d", "th", "at", "count", "offset", "data")
    pieces = stored(wide.mapInArrow(cells, "key long, n long, d long, th long, at long, count int, cell int, core long, span long, data binary"), "cells")
    lone = stored(_place(pieces, "key", "cell", "span"), "lone-cells")
    settled = _whole(pieces.where("n = 1"), lone)
    # cells of one string are counted once; those with a core of their own hold no repeated window
    bare = _place(pieces, "key", "cell", "core")
    weights = pieces.groupBy("key", "cell", "span").agg(F.sum("n").alias("n"), F.min_by(F.struct("d", "th", "at", "count", "data"), F.struct("d", "th", "at")).alias("r")).select("key", "n", "r.*")
    asked = weights.join(bare, ["d", "th", "at"], "left_anti")

    def windows(batches):
        for batch in (b.slice(lo, CHUNK) for b in batches for lo in range(0, b.num_rows, CHUNK)):
            data = batch.column(6)
            count = batch.column(5).to_numpy().astype(np.int64)
            starts = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data)].astype(np.int64)
            base = starts - starts[0]
            flat = np.frombuffer(data.buffers()[2], np.uint8)[starts[0] : starts[-1] + count[-1] - 1 + LENGTH]
            hashes = _hashes(flat, True)[1]
            row = np.repeat(np.arange(len(count)), count)
            window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            columns = [batch.column(i).to_numpy()[row] for i in (0, 1, 2, 3)]
            at = batch.column(4).to_numpy()[row] + window
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(at), pa.array(hashes[base[row] + window].view(np.int64))], ["key", "n", "d", "th", "at", "h"])

    asked = asked.select("key", "n", "d", "th", "at", "count", "data")
    each = stored(asked.mapInArrow(windows, "key long, n long, d long, th long, at long, h long"), "windows")
    single = each.where("n = 1").withColumn("count", F.lit(1))
    return whole.unionAll(settled).unionAll(_whole(single, _place(each, "key", "h"))), few


def remove_repeats(docs: DataFrame, hot: int = HOT, filter_bits: int = FILTER_BITS, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if ``texts``) of each row.

    Every byte that a LENGTH-byte string covers which starts anywhere else as well is removed. Null texts are empty.
    Rows are known by id and text: repeated rows repeat each other. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)).alias("d"),
        F.xxhash64(docs["text"].cast("string"), docs["doc_id"].isNull()).alias("th"),
        docs["text"].cast("string").alias("text"),
        docs["doc_id"].cast("long").alias("doc_id"),
    )
    spans = stored(repeats(named.drop("doc_id"), hot, filter_bits).groupBy("d", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    suspects = spark.sparkContext.broadcast(bloom_filter(spans.select(F.xxhash64("d", "th").alias("k")), _bits(spans.count(), filter_bits)))

    def settle(batches):
        """Texts without repeats are done; the others' texts travel."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                data = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()]
                hit = bloom_has(suspects.value, part.column(4).to_numpy())
                digest = [None if h else hashlib.sha256(x).hexdigest() for x, h in zip(data, hit)]
                bodies = [x if h else None for x, h in zip(data, hit)]
                kept = [None if h or not texts else x for x, h in zip(data, hit)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array([len(x) for x in data], pa.int64()), pa.array(digest, pa.string()), pa.array(bodies, pa.binary()), pa.array(kept, pa.binary())],
                    ["d", "th", "doc_id", "n_bytes", "kept_sha256", "body", "kept"],
                )

    first = named.withColumn("k", F.xxhash64("d", "th")).mapInArrow(settle, "d long, th long, doc_id long, n_bytes long, kept_sha256 string, body binary, kept binary")

    def cut(batches):
        for batch in batches:
            out = []
            for doc, n, digest, body, kept, ranges in zip(*(batch.column(i).to_pylist() for i in range(6))):
                removed = runs = 0
                if body is not None:
                    left, at = [], 0
                    for lo, hi in _merged(ranges or []):
                        left.append(body[at:lo])
                        removed += hi - lo
                        runs += 1
                        at = hi
                    left.append(body[at:])
                    kept = b"".join(left)
                    digest = hashlib.sha256(kept).hexdigest()
                out.append((doc, n, removed, runs, digest, kept if texts else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    joined = first.join(spans, ["d", "th"], "left").select("doc_id", "n_bytes", "kept_sha256", "body", "kept", "spans")
    done = joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if texts else done.drop("kept")


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out
