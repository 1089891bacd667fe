"""Ranked search, whitening and bin completion against plain programs and SQL."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectrel.llm import binpacking, fullpacking, lexical, whitening
from spectrel.llm.queries import oracle_sql, queries, word_tokenizer
from spectrel.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score long, term string, shard long"
ODD = [None, "", " .,", "a", "B b's 9x", "été Été ÉTÉ 中文 é́", "the the THE other", "x" * 3000, "the one  the_two\nthe-three", "same", "same"]


def odd_docs(spark, null_id=True):
    rows = [(i, t, None, "clash", None) for i, t in enumerate(ODD)] + [(3, "a the", 1, None, 1), (3, "a the", 1, None, 1)]
    return spark.createDataFrame(rows + [(None, "the null one", None, None, None)] * null_id, DOCS)


# ---------------------------------------------------------------- ranked search


def plain_terms(text):
    return re.findall(lexical.TERMS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    """(item, rank, doc_id, score); docs and items are lists of (id, text)."""
    bags = [(doc, Counter(plain_terms(text))) for doc, text in docs]
    n = sum(1 for _, bag in bags if bag)
    total = sum(sum(bag.values()) for _, bag in bags)
    df = Counter(term for _, bag in bags for term in bag)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in wanted.items():
        found = []
        for doc, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms if bag[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def searched(docs, items, **kw):
    return sorted((tuple(r) for r in lexical.search(lexical.build(docs), items, **kw).collect()), key=str)


@pytest.mark.parametrize("shard, block", [(1 << 23, 4096), (900, 3)])
def test_search_equals_the_plain_program(spark, shard, block, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_ROWS", 40 if block == 3 else 1 << 16)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "ITEMS", 7 if block == 3 else 256)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert searched(docs, items) == want


def test_search_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = sorted(con.sql(oracle_sql()["op11_lexical"]).fetchall())
    got = queries()["op11_lexical"](spark, SF)
    assert got.columns[:4] == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == want


def test_search_of_odd_rows(spark):
    """Nulls, no terms, repeated ids of documents and items, ties, and columns with clashing names."""
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, "the A same", 0), (1, "été 9X", 0), (2, None, 0), (3, "?!", 0), (None, "b s", 0), (4, "x" * 3000, 0)], "item_id long, text string, rank int")
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert searched(docs, items) == want and len(want) > 8
    assert searched(docs.limit(0), items) == [] == searched(docs, items.limit(0))


def test_search_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 1 << 12)
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(300)])
    rows = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate([60_000, 10, 500])] + [(9, "z" * 50_000 + " w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(0, "w1 w2 w3"), (1, "z" * 50_000)], "item_id long, text string")
    assert searched(docs, items) == plain_search(rows, [(0, "w1 w2 w3"), (1, "z" * 50_000)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=50))
def test_variable_length_bytes(values):
    data, ends = lexical.to_bytes(np.array(values, np.int64), np.arange(len(values) + 1))
    assert lexical.from_bytes(data.tobytes()).tolist() == values
    assert [lexical.from_bytes(data[a:b].tobytes()).tolist() for a, b in zip(ends[:-1], ends[1:])] == [[v] for v in values]


# ---------------------------------------------------------------- whitening


def plain_whitening(vectors):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    points = np.unique(x, axis=0)
    n, sums = len(points), points.sum(axis=0)
    centred = points - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:16]
    deviation = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
    return n, deviation, (x - sums / n) @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_equals_the_plain_program(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    n, deviation, whitened, explained = plain_whitening([r["embedding"] for r in rows])
    found = queries()["op12_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert found.vec_id.tolist() == np.repeat([r["vec_id"] for r in rows], 16).tolist()
    assert found.component.tolist() == list(range(1, 17)) * len(rows) and set(found.n) == {n}
    assert found.deviation.tolist()[::16] == deviation.tolist()
    got = found.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(got * np.sign((got * whitened).sum(axis=0)) - whitened).max() < 1e-8
    assert np.allclose(found.explained.to_numpy()[:16], explained, rtol=1e-10)
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-9


def test_whitening_of_odd_rows(spark):
    """Null vectors and entries, entries that aren't finite, other lengths, repeated rows and ids, one length without variance."""
    rng = np.random.default_rng(5)
    good = rng.normal(size=(40, 3)).tolist()
    rows = [(i, v, "s") for i, v in enumerate(good)] + [(0, good[0], "s"), (None, good[1], None)]
    bad = [(50, None, ""), (51, [1.0, None, 2.0], ""), (52, [1.0, float("nan"), 0.0], ""), (53, [float("inf"), 0.0, 0.0], ""), (54, [], ""), (55, [1.0, 2.0], ""), (56, [1.0, 2.0], "")]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, component string")
    n, deviation, whitened, _ = plain_whitening(good)
    found = whitening.whiten(table).toPandas()
    assert len(found) == 3 * 42 and set(found.n) == {n} and n == 40
    assert sorted(found.vec_id.dropna().astype(int).unique()) == list(range(40)) and found.vec_id.isna().sum() == 3
    first = found[found.vec_id == 7].sort_values("component")
    assert set(first.deviation) == {deviation[7]} and np.allclose(np.abs(first.whitened), np.abs(whitened[7]), atol=1e-9)
    other = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.5]), (3, [0.0, 4.0]), (4, [1.0]), (5, [2.0])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in whitening.whiten(other).collect()) == [(1, 1, 3), (1, 2, 3), (2, 1, 3), (2, 2, 3), (3, 1, 3), (3, 2, 3), (4, 1, 2), (5, 1, 2)]
    assert whitening.whiten(table.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=8), st.integers(0, 10**6))
def test_merged_moments_equal_those_of_all(sizes, seed):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(-(10**6), 10**6, (n, 4)) for n in sizes]
    merged = {}
    for p in parts:
        merged = whitening.merge_all(merged, {4: whitening.moments(p)})
    n, sums, mean, scatter = whitening.moments(np.concatenate(parts))
    got = merged[4]
    assert got[0] == n and (got[1] == sums).all() and np.allclose(got[2], mean) and np.allclose(got[3], scatter, rtol=1e-9, atol=1e-3)


# ---------------------------------------------------------------- bin completion


def fewest_bins(sizes, capacity):
    """By trying everything."""
    sizes, found = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(sizes):
            found[0] = len(bins)
            return
        for room in {b for b in bins if b >= sizes[i]}:
            j = bins.index(room)
            go(i + 1, [*bins[:j], room - sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return found[0]


def plain_best_fit(sizes, capacity):
    bins: list[int] = []
    for size in sorted(sizes, reverse=True):
        room = min((b for b in bins if b >= size), default=None)
        if room is None:
            bins.append(capacity - size)
        else:
            bins[bins.index(room)] -= size
    return len(bins)


@settings(max_examples=150, deadline=None)
@given(st.integers(6, 50).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=10))))
def test_completion_finds_the_fewest_bins(case):
    capacity, sizes = case
    counts = np.bincount(np.array(sizes, np.int64), minlength=capacity + 1)
    fillings, bound = binpacking.pack(counts)
    held = Counter()
    for lengths, bins in fillings:
        assert bins > 0 and sum(s * m for s, m in lengths) <= capacity
        for s, m in lengths:
            held[s] += m * bins
    assert held == Counter(sizes)
    used = sum(n for _, n in fillings)
    assert bound <= used == fewest_bins(sizes, capacity)
    assert sum(n for _, n in binpacking.best_fit(counts)) == plain_best_fit(sizes, capacity)


def test_completion_beats_best_fit():
    # 5 + 3 + 2 and 4 + 4 + 2 twice: best fit puts 5 with 5, 4 with 4, and needs one bin more
    counts = np.bincount([5, 3, 2, 5, 3, 2, 4, 4, 2], minlength=11)
    assert sum(n for _, n in binpacking.pack(counts)[0]) == 3
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1200, 1500, 3000), minlength=4097)
    assert sum(n for _, n in binpacking.pack(counts)[0]) == 1000 < sum(n for _, n in binpacking.best_fit(counts))


def check_places(pieces, ids, capacity):
    """Each id of each row's tokens lies in one piece, pieces don't overlap, and only long documents are cut."""
    pieces = pieces.sort_values(["sequence_id", "offset"])
    for _, own in pieces.groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= capacity
    want = Counter()
    for doc, tokens in ids:
        for piece, at in enumerate(range(0, len(tokens), capacity)):
            part = np.asarray(tokens[at : at + capacity], "<u4")
            want[(doc, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    columns = [pieces.doc_id.astype(object).where(pieces.doc_id.notna(), None), pieces.piece, pieces.start, pieces.length, pieces.ids_crc32]
    assert Counter(zip(*columns)) == want


def tokens_of(docs):
    enc = Encoder(word_tokenizer())
    rows = docs.select("doc_id", "text").collect()
    return [(r["doc_id"], enc.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in rows]


def test_whole_documents_in_few_sequences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries()["op13_best_fit"](spark, SF).toPandas()
    ids = tokens_of(docs)
    check_places(found, ids, fullpacking.CAPACITY)
    sizes = [min(4096, len(t) - at) for _, t in ids for at in range(0, len(t), 4096)]
    assert found.sequence_id.nunique() == found.sequences.iloc[0] <= plain_best_fit(sizes, 4096)
    assert found.least_sequences.iloc[0] >= -(-sum(sizes) // 4096)


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_packing_whole_odd_rows(spark, capacity):
    docs = odd_docs(spark).repartition(5)
    found = fullpacking.pack_whole(docs, word_tokenizer(), capacity=capacity).toPandas()
    check_places(found, tokens_of(docs), capacity)
    assert fullpacking.pack_whole(docs.limit(0), word_tokenizer()).count() == 0


def test_word_encoder_equals_the_library(spark):
    enc = Encoder(word_tokenizer(), cache=3000)
    assert enc.words
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["<|ENDOFTEXT|> <|endoftext|>", "IT'S we'll ''s 1234 İK"]
    for at in range(0, len(texts), 50):
        ids, n = enc.encode(texts[at : at + 50], end=1)
        want = [e.ids + [1] for e in enc.tokenizer.encode_batch([t or "" for t in texts[at : at + 50]], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_word_encoder_on_any_text(texts):
    enc = test_word_encoder_on_any_text.__dict__.setdefault("enc", Encoder(word_tokenizer()))
    ids, n = enc.encode(texts)
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
