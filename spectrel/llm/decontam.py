"""Benchmark decontamination by winnowing.

Words of both sides are hashed to 64 bits; of every W consecutive K-gram hashes the least is kept (of equals the last).
Any shared span of K + W - 1 words holds W consecutive K-grams, and both sides keep the same one of them, so with
K + W - 1 equal to the window's words no shared window is missed. Kept hashes of documents pass a Bloom filter of the
benchmark's (its size is a parameter, whatever the data), are joined with the benchmark's, and each pair is extended to
both sides by comparing word hashes: a run of at least a window's length is a hit. Items shorter than a window are
looked up as one gram of their own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom_filter, bloom_has, mixed, packed_bytes, small_batches, stored, text_slices, word_hashes

WINDOW = 10
K = 5
#: Bits of the Bloom filter: 4 MB. More benchmark hashes only let more candidates through to the join.
FILTER_BITS = 1 << 25

_WORD = np.zeros(256, np.uint8)
_WORD[ord("0") : ord("9") + 1] = 1
_WORD[ord("a") : ord("z") + 1] = 1
_WORD[ord("A") : ord("Z") + 1] = 1
_WORD[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and each text's number of words."""
    buf, starts, _ = packed_bytes(texts)
    first, _, h = word_hashes(_LOWER[buf], _WORD)
    counts = np.diff(np.searchsorted(first, starts), append=len(first))
    return h, counts


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position (positions too near the end: of fewer, cut off by the caller)."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, 0x51ED270B7F4A7C15 + k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mixed(out * np.uint64(0x2545F4914F6CDD1D) + h[i : i + n])
    return out


def winnowed(h: np.ndarray, counts: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the joined words) and hashes of the kept k-grams. Texts of fewer words than ``window`` keep none."""
    w = window - k + 1
    g = grams(h, k)
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.repeat(np.cumsum(counts), counts)
    start = np.flatnonzero(np.arange(n) + window <= ends[:n])
    best, at = g[start + w - 1], start + w - 1
    for i in range(w - 2, -1, -1):
        less = g[start + i] < best
        best, at = np.where(less, g[start + i], best), np.where(less, start + i, at)
    kept = np.unique(at)
    return kept, g[kept]


_SCHEMA = "row long, id long, n_words long, grams array<struct<gram:long, place:long, before:int, size:int, reach:int, words:array<long>>>"


def _kept(texts: pa.Array, short: list[int] | None, passes, k: int, window: int) -> tuple[np.ndarray, pa.Array]:
    """Each text's number of words, and its kept grams with the word hashes up to ``reach`` before and after each.

    ``short``: lengths below a window of which every gram is kept; None: the text itself, if it is so short.
    """
    h, counts = hashed_words(texts)
    ends = np.cumsum(counts)
    at, g = winnowed(h, counts, k, window)
    found = [(at, g, k, window - k)]
    word_ends = np.repeat(ends, counts)
    for m in range(1, window) if short is None else short:
        # the seed keeps these apart from the k-grams
        g = mixed(grams(h, m) + np.uint64(m))
        if short is None:
            at = (ends - counts)[counts == m]
        else:
            at = np.flatnonzero(np.arange(len(g)) + m <= word_ends[: len(g)])
        found.append((at, g[at], m, 0))
    columns: list[list[np.ndarray]] = [[] for _ in range(8)]
    for at, g, size, reach in found:
        if passes is not None and len(at):
            some = passes(g)
            at, g = at[some], g[some]
        text = np.searchsorted(ends, at, side="right")
        first = ends[text] - counts[text]
        lo, hi = np.maximum(at - reach, first), np.minimum(at + size + reach, ends[text])
        for c, x in zip(columns, (text, g.view(np.int64), at - first, at - lo, np.full(len(at), size), np.full(len(at), reach), lo, hi)):
            c.append(x)
    text, gram, place, before, sizes, reaches, lo, hi = (np.concatenate(c) for c in columns)
    order = np.lexsort((place, text))
    length = (hi - lo)[order]
    words = h[spread_positions(lo[order], length)].view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(words))
    ints = [pa.array(x[order], t) for x, t in ((gram, pa.int64()), (place, pa.int64()), (before, pa.int32()), (sizes, pa.int32()), (reaches, pa.int32()))]
    structs = pa.StructArray.from_arrays([*ints, lists], ["gram", "place", "before", "size", "reach", "words"])
    bounds = np.searchsorted(text[order], np.arange(len(counts) + 1))
    return counts, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs)


def spread_positions(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _rows(texts: DataFrame, short, passes, k: int, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, hi in text_slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                counts, kept = _kept(part.column(2), short, passes, k, window)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts), kept], ["row", "id", "n_words", "grams"])

    return texts.mapInArrow(run, _SCHEMA)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, filter_bits: int = FILTER_BITS) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Null and empty texts have no
    words: no hits, and such items never occur. Texts are read whole, and ids of items may be of any type. ``spans`` are the hit runs of words [from, to), null if none. Items
    without an id take no part; repeated item rows count once for each item_id. Each row of ``docs`` is judged on its
    own, also where ids repeat or are null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    # items go by the numbers of their rows, as ids may be of any type
    asked = stored(items.where(items["item_id"].isNotNull()).select(F.monotonically_increasing_id().alias("id"), items["item_id"].cast("string").alias("name"), items["text"].cast("string").alias("text")), "asked")
    wanted = stored(_rows(asked.select(F.lit(0).cast("long").alias("row"), "id", "text"), None, None, k, window).select("id", F.explode("grams").alias("g")).select(F.col("id").alias("item_id"), "g.*").distinct(), "items")
    short = sorted(r["size"] for r in wanted.where("reach = 0").select("size").distinct().collect())
    held = spark.sparkContext.broadcast(bloom_filter(wanted.select("gram").distinct(), filter_bits))

    def passes(g: np.ndarray) -> np.ndarray:
        return bloom_has(held.value, g)

    each = stored(_rows(numbered, short, passes, k, window), "grams")
    near = each.where(F.size("grams") > 0).select("row", F.explode("grams").alias("o")).select("row", "o.*")
    other = wanted.select("item_id", "gram", *(F.col(c).alias(f"i_{c}") for c in ("before", "size", "reach", "words")))
    pairs = near.join(other, "gram").where("size = i_size and reach = i_reach")
    same = lambda i: F.coalesce(F.get("words", F.col("before") + i) == F.get("i_words", F.col("i_before") + i), F.lit(False))
    run_of = lambda at: F.aggregate(F.sequence(F.lit(0), F.col("reach")), F.lit(0), lambda n, i: F.when((n == i) & (i < F.col("reach")) & at(i), n + 1).otherwise(n))
    runs = pairs.where(F.forall(F.sequence(F.lit(0), F.col("size") - 1), same)).select(
        "row", "item_id", "place", F.col("size").alias("n"), "reach",
        run_of(lambda i: same(-i - 1)).alias("back"),
        run_of(lambda i: same(F.col("size") + i)).alias("ahead"),
    )
    hits = stored(runs.where("back + n + ahead >= n + reach").select("row", "item_id", (F.col("place") - F.col("back")).alias("lo"), (F.col("place") + F.col("n") + F.col("ahead")).alias("hi")), "hits")
    before = Window.partitionBy("row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    fresh = hits.select("row", "lo", "hi").distinct().withColumn("reached", F.coalesce(F.max("hi").over(before), F.lit(0)))
    starts = fresh.withColumn("island", F.sum((F.col("lo") > F.col("reached")).cast("int")).over(Window.partitionBy("row").orderBy("lo", "hi")))
    spans = starts.groupBy("row", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy("row").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans")
    )
    named = hits.select("row", "item_id").distinct().join(asked.select(F.col("id").alias("item_id"), "name"), "item_id")
    found = named.groupBy("row").agg(F.collect_set("name").alias("names")).select("row", F.size("names").cast("long").alias("n_items"), F.concat_ws(",", F.array_sort("names")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return each.select("row", F.col("id").alias("doc_id"), "n_words").join(spans, "row", "left").join(found, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans",
    )
