import itertools
import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.operators import access, calibration, features, inference, ordered, proteins, psm, rangejoin, splines, stabbing, windows

# ---------------------------------------------------------------- inference, against plain programs


def graph_of(seed: int) -> dict[str, set[str]]:
    """Proteins and their peptides: sparse clusters, some with proteins of equal peptides, parts of others, and chains."""
    rng = np.random.default_rng(seed)
    out: dict[str, set[str]] = {}
    for c in range(9):
        pool = [f"c{c}k{i}" for i in range(int(rng.integers(1, 8)))]
        for i in range(int(rng.integers(1, 7))):
            out[f"c{c}q{i}"] = set(rng.choice(pool, int(rng.integers(1, min(4, len(pool)) + 1)), replace=False).tolist())
    out |= {"twinA": {"t1", "t2"}, "twinB": {"t1", "t2"}, "partOf": {"t2"}, "lone": {"x1"}}
    return out


@pytest.fixture(scope="module", params=[3, 4])
def graph(request):
    return graph_of(request.param)


@pytest.fixture(scope="module")
def edges(spark, graph):
    return spark.createDataFrame([(q, k) for q, ks in graph.items() for k in sorted(ks)] * 2, "protein string, peptide string")


@pytest.fixture(scope="module")
def groups(edges):
    return {k: v.collect() for k, v in inference.protein_groups(edges).items()}


def column(df, name="protein"):
    return {r[name] for r in df.collect()}


def merged_of(graph):
    """First protein of each set of peptides, and the proteins of that set."""
    sets: dict = {}
    for q in sorted(graph):
        sets.setdefault(frozenset(graph[q]), []).append(q)
    return {qs[0]: qs for qs in sets.values()}


def users_of(graph):
    return Counter(k for ks in graph.values() for k in ks)


def greedily_redundant(graph):
    """Few peptides first, then those of frequent peptides, then names from the end; gone is what the others still explain."""
    left, users = dict(graph), users_of(graph)
    turns = sorted(sorted(graph, reverse=True), key=lambda q: (len(graph[q]), [-n for n in sorted((users[k] for k in graph[q]), reverse=True)]))
    for q in turns:
        if all(any(k in other for p, other in left.items() if p != q) for k in graph[q]):
            del left[q]
    return set(graph) - set(left)


def supersets_of(graph):
    return {q: {p for p in graph if graph[q] < graph[p]} for q in graph if any(graph[q] < graph[p] for p in graph)}


def test_clusters(edges, graph):
    near = {q: {p for p in graph if graph[p] & graph[q]} for q in graph}
    for _ in graph:
        near = {q: set().union(*(near[p] for p in near[q])) for q in graph}
    assert {r["protein"]: r["cluster"] for r in inference.clusters(edges).collect()} == {q: min(near[q]) for q in graph}


def test_samesets(edges, graph):
    assert {r["representative"]: r["members"] for r in inference.samesets(edges).collect()} == merged_of(graph)


def test_unique(edges, graph):
    users = users_of(graph)
    assert column(inference.unique_proteins(edges)) == {q for q, ks in graph.items() if any(users[k] == 1 for k in ks)}
    assert column(inference.unique_peptides(edges), "peptide") == {k for k, n in users.items() if n == 1}


def test_subsets(edges, graph):
    got: dict = {}
    for r in inference.subsets(edges).collect():
        got.setdefault(r["protein"], set()).add(r["superset"])
    assert got == supersets_of(graph)


def test_redundant(edges, graph):
    assert column(inference.redundant_proteins(edges)) == greedily_redundant(graph)


def giant(kind):
    """One cluster: all proteins share a peptide, a chain in the order of names, a ring of pairs, or a hot protein of all peptides."""
    rng = np.random.default_rng(3)
    if kind == "star":
        return {f"p{i:04}": {"all", f"k{rng.integers(60)}", f"k{rng.integers(60)}"} for i in range(400)}
    if kind == "chain":
        return {f"p{i:04}": {f"k{i // 2}", f"k{(i + 1) // 2}", f"m{i // 8}"} for i in range(48)}
    if kind == "ring":
        names = rng.permutation(300)
        return {f"p{names[i]:04}": {f"k{i}", f"k{(i + 1) % 300}"} for i in range(300)}
    return {"whole": {f"k{i}" for i in range(500)}} | {f"p{i:04}": {f"k{j}" for j in rng.integers(0, 500, rng.integers(1, 9))} for i in range(400)}


@pytest.mark.parametrize("kind", ["star", "chain", "ring", "hot"])
def test_redundant_in_one_giant_cluster(spark, kind):
    graph = giant(kind)
    edges = spark.createDataFrame([(q, k) for q, ks in graph.items() for k in ks], "protein string, peptide string")
    want = greedily_redundant(graph)
    assert want and column(inference.redundant_proteins(edges.repartition(3))) == want


def test_redundant_without_edges(edges):
    assert inference.redundant_proteins(edges.limit(0)).count() == 0
    assert inference.redundant_proteins(edges.limit(1)).count() == 0


def plain_groups(graph):
    """(group, protein, role), and the leading proteins.

    Leading: neither part of another protein nor redundant among the rest; what is redundant joins all that share a peptide with it.
    """
    same = merged_of(graph)
    own = {q: graph[q] for q in same}
    users = users_of(own)
    below = {q: ps for q, ps in supersets_of(own).items() if all(users[k] > 1 for k in own[q])}
    rest = {q: ks for q, ks in own.items() if q not in below}
    spare = greedily_redundant(rest)
    want: set = {(q, m, "leading") for q in set(rest) - spare for m in same[q]}
    for q, ps in below.items():
        want |= {(p, m, "subset") for p in ps - spare if p in rest for m in same[q]}
    joins = {q: {p for p in set(rest) - spare if own[p] & own[q]} for q in spare}
    for q, ps in below.items():
        if not any(p in rest and p not in spare for p in ps):
            joins[q] = set().union(*(joins.get(p, set()) for p in ps))
    want |= {(p, m, "subsumable") for q, ps in joins.items() for p in ps for m in same[q]}
    return want, {m for q in set(rest) - spare for m in same[q]}


def plain_classes(graph, roles):
    """The class of each peptide, by the groups that hold it."""
    users = users_of({q: graph[q] for q in merged_of(graph)})
    holders: dict = {}
    for g, q, role in roles:
        for k in graph[q]:
            holders.setdefault(k, set()).add((g, role))
    want = {}
    for k in users:
        of = {g for g, role in holders[k] if role != "subsumable"}
        spare = any(role == "subsumable" for _, role in holders[k])
        want[k] = "shared" if len(of) > 1 else "unique" if users[k] == 1 else "groupSubsumable" if spare else "groupUnique"
    return want


def test_groups(groups, graph):
    want, leading = plain_groups(graph)
    assert {(r["group"], r["protein"], r["role"]) for r in groups["members"]} == want
    assert {r["protein"] for r in groups["proteins"] if r["isLeading"]} == leading


def test_groups_without_clusters_ask_for_no_components(spark, edges, groups, monkeypatch):
    monkeypatch.setattr(inference, "components", None)
    got = inference.protein_groups(edges, with_clusters=False)
    assert set(got) == {"members", "peptides"}
    for name, df in got.items():
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, groups[name]))


def test_subsets_of_proteins_with_more_peptides_than_bits(spark):
    rng = np.random.default_rng(2)
    sets = {f"q{i}": set(rng.choice(200, int(n), replace=False).tolist()) for i, n in enumerate(rng.integers(70, 190, 8))}
    sets |= {f"{q}-part": set(sorted(own)[: len(own) // 2]) for q, own in sets.items()}
    table = spark.createDataFrame([(q, f"k{k}") for q, own in sets.items() for k in own], "protein string, peptide string")
    want = {(a, b) for a in sets for b in sets if sets[a] < sets[b]}
    got = [tuple(r) for r in inference.subsets(table).collect()]
    assert len(want) >= 8 and set(got) == want and len(got) == len(want)


def test_peptide_classes(groups, graph):
    roles = {(r["group"], r["protein"], r["role"]) for r in groups["members"]}
    assert {r["peptide"]: r["class"] for r in groups["peptides"]} == plain_classes(graph, roles)


def test_scan_keeps_the_order_of_ties(spark):
    t = spark.createDataFrame([("a", "1", 0, 2.0), ("a", "2", 1, 2.0), ("b", "3", 2, None), ("b", "4", 3, 1.0)], "specfile string, id string, ord long, v double")
    assert [r["id"] for r in access.scan(t, sort="v", reverse=True).collect()] == ["1", "2", "4"]
    assert [r["id"] for r in access.scan(t, ["b"], sort="v").collect()] == ["4"]
    assert access.project(t, ["v", "w"], -1.0).where("id = '3'").first()["v"] == -1.0


def test_rank_and_validity(spark):
    t = spark.createDataFrame([("r", "1", 0, 5.0, 0.001), ("r", "1", 1, 9.0, 0.001), ("r", "2", 0, 7.0, 0.001), ("r", "2", 1, 7.0, 0.5), ("r", "3", 0, 1.0, None)], "specfile string, id string, ord long, score double, qValue double")
    ranked = psm.rank_psms(t)
    assert sorted((r["id"], r["ord"], r["rank"]) for r in ranked.collect()) == [("1", 0, 2), ("1", 1, 1), ("2", 0, 1), ("2", 1, 1), ("3", 0, 1)]
    valid = lambda df: sorted((r["id"], r["ord"]) for r in df.where("isValid").collect())
    assert valid(psm.validate_psms(ranked)) == [("2", 0)]
    assert valid(psm.validate_psms(ranked, qc_order="rank")) == [("1", 1), ("2", 0)]


def test_calculated_mz(spark):
    t = spark.createDataFrame([("r", "1", "AADITSLYK", True, 491.2662, None), ("r", "2", "AADITSLYK", False, 1.0, 2)], "specfile string, id string, peptide string, isValid boolean, obsMz double, charge int")
    rows = {r["id"]: r for r in psm.add_calculated_mz(t).collect()}
    assert rows["1"]["charge"] == 2 and rows["1"]["excMz"] == pytest.approx(491.266207, abs=1e-5) and rows["2"]["excMz"] is None


def test_tolerance_join_is_the_plain_join(spark):
    rng = np.random.default_rng(1)
    a = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.uniform(100, 120, 200))], "i int, a double")
    b = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.uniform(100, 120, 200))], "j int, b double")
    for mode, tol in (("relative", 1e-3), ("absolute", 0.1)):
        got = {(r["i"], r["j"]) for r in rangejoin.tolerance_join(a, b, "a", "b", tol, mode).collect()}
        reach = F.col("a") * tol if mode == "relative" else F.lit(tol)
        plain = {(r["i"], r["j"]) for r in a.crossJoin(b).where(F.col("b").between(F.col("a") - reach, F.col("a") + reach)).collect()}
        assert got == plain


def test_feature_matching_cascade(spark):
    spectra = spark.createDataFrame([("r", "s1", 500.0, 10.0, 2), ("r", "s2", 500.0, 30.0, 2), ("r", "s3", 500.0, 10.0, None), ("r", "s4", 499.4983, 10.0, 2)], "specfile string, specId string, mass double, rt double, charge int")
    feats = spark.createDataFrame([("r", "f1", 500.0, 5.0, 15.0, 2), ("r", "f2", 500.001, 25.0, 35.0, 2), ("r", "f3", 500.0, 26.0, 36.0, 2)], "specfile string, featureId string, mass double, rtLow double, rtHigh double, charge int")
    rows = {r["specId"]: (r["error"], r["single"], r["featureId"]) for r in features.match_features(spectra, feats, 10e-6, isotope_errors=(0, 1)).collect()}
    assert rows == {"s1": (0.0, True, "f1"), "s2": (0.0, False, None), "s4": (1.0, True, "f1")}


@pytest.mark.parametrize("mode, tolerance", [("relative", 1e-2), ("absolute", 0.5), ("absolute", 0.0)])
def test_nearest_match_equals_the_plain_join(spark, mode, tolerance):
    """Equal values, equal distances, values whose distances round to the same, nulls, and left keys of several rows."""
    rng = np.random.default_rng(5)
    some = lambda n: [None, 100.0, 1e-20, 2e-20, -1.0, 0.5, *rng.uniform(100, 130, n), *np.round(rng.uniform(100, 110, n) * 4) / 4]
    rows = lambda n, start: [(int(i // start), None if v is None else float(v), None if i % 29 == 9 else int(i % 3)) for i, v in enumerate(some(n))]
    a = spark.createDataFrame(rows(90, 2), "i int, a double, k int").repartition(5)
    b = spark.createDataFrame([(-j, v, k) for j, v, k in rows(70, 1)], "j int, b double, k int").repartition(5)
    for on in (["k"], None):
        got = rangejoin.nearest_match(a, b if on else b.drop("k"), ["i"], "a", "b", tolerance, mode, on, ["j"]).select("i", "a", "j", "b").collect()
        pairs = [(x, y) for x in a.collect() for y in b.collect() if None not in (x.a, y.b) and (not on or (x.k is not None and x.k == y.k))]
        reach = lambda v: v * tolerance if mode == "relative" else tolerance
        best: dict = {}
        for x, y in pairs:
            if x.a - reach(x.a) <= y.b <= x.a + reach(x.a) and (mode == "absolute" or min(x.a, y.b) > 0):
                best[x.i] = min(best.get(x.i, (math.inf,)), (abs(y.b - x.a), y.j, x.a, y.b))
        assert len(best) > 10 and sorted(tuple(r) for r in got) == sorted((i, v, j, w) for i, (_, j, v, w) in best.items())


def test_nearest_match_of_dense_values_makes_no_pairs(spark):
    """All of 80,000 values lie within the tolerance of all others."""
    left = spark.range(80_000).select("id", (F.col("id") / 80_000).alias("a"))
    right = spark.range(80_000).select(F.col("id").alias("other"), (F.col("id") / 80_000).alias("b"))
    began = time.monotonic()
    assert rangejoin.nearest_match(left, right, ["id"], "a", "b", 2.0, "absolute", None, ["b", "other"]).where("id = other").count() == 80_000
    assert time.monotonic() - began < 60


def plain_matches(spectra, feats, tolerance, mode, errors, step):
    """(specId: error, single, feature), each spectrum against each feature."""
    inf = float("inf")
    order = lambda x: (1, 0.0) if x != x else (0, x)  # noqa: E731  NaN is the greatest
    found = {}
    for run, spec, mass, rt, charge in spectra:
        for error in errors if None not in (run, mass, rt, charge) else ():
            wanted = mass + error * step / charge
            reach = wanted * tolerance if mode == "relative" else tolerance
            if mode == "relative" and not 0 < wanted < inf:
                continue
            met = []
            for r, f, m, low, high, z in feats:
                if None in (m, low, high) or r != run or z != charge or not (wanted - reach <= m <= wanted + reach):
                    continue
                width = high - low
                if order(low + width * -0.05) <= order(rt) <= order(high + width * 0.10):
                    met.append((f, order(low) <= order(rt) <= order(high)))
            left = [f for f, tight in met if tight] if len(met) > 1 else [f for f, _ in met]
            if left:
                found[spec] = (error, len(left) == 1, left[0] if len(left) == 1 else None)
                break
    return found


@pytest.mark.parametrize("mode, tolerance, rows, points", [("relative", 5e-3, 1 << 17, 1 << 18), ("relative", 5e-3, 20, 15), ("absolute", 0.4, 1 << 17, 1 << 18), ("absolute", 0.4, 10, 20), ("absolute", 0.0, 1 << 17, 1 << 18)])
def test_feature_matching_equals_the_plain_program(spark, mode, tolerance, rows, points, monkeypatch):
    """Sparse and dense masses, lattices (edges are met exactly), odd rows; cells of many rows, and cells dealt over several groups."""
    monkeypatch.setattr(stabbing, "ROWS", rows)
    monkeypatch.setattr(stabbing, "POINTS", points)
    rng = np.random.default_rng(len(mode) + rows)
    masses = lambda n: np.concatenate([rng.uniform(100, 900, n), np.round(rng.uniform(100, 104, n), 1), [100.0] * 20])
    spectra = [("ab"[i % 2], f"s{i}", float(m), float(rng.integers(0, 200)), int(i % 3 + 1)) for i, m in enumerate(masses(250))]
    spectra += [("a", "n1", None, 5.0, 1), ("a", "n2", 100.0, None, 1), ("a", "n3", 100.0, 5.0, None), (None, "n4", 100.0, 5.0, 1), ("a", "n5", -1.0, 50.0, 1), ("a", "n6", 100.0, float("nan"), 1), ("a", "n7", 100.0, float("inf"), 1)]
    feats = [("ab"[i % 2], f"f{i}", float(m), float(t), float(t + w), int(i % 3 + 1)) for i, (m, t, w) in enumerate(zip(masses(150), rng.integers(0, 200, 320), rng.integers(0, 30, 320)))]
    feats += [("a", "o1", None, 0.0, 9.0, 1), ("a", "o2", 100.0, None, 9.0, 1), ("a", "o3", 102.0, 9.0, 0.0, 1), (None, "o4", 100.0, 0.0, 9.0, 1), ("a", "o5", 103.0, -1e9, 1e9, 1), ("a", "o6", 2.1, 0.0, 99.0, 1)]
    a = spark.createDataFrame(spectra, "specfile string, specId string, mass double, rt double, charge int")
    b = spark.createDataFrame(feats, "specfile string, featureId string, mass double, rtLow double, rtHigh double, charge int")
    matched = features.match_features(a, b, tolerance, mode, (0, 1), isotope_step=3.0, keep=("mass",)).collect()
    want = plain_matches(spectra, feats, tolerance, mode, (0, 1), 3.0)
    assert {r["specId"]: (r["error"], r["single"], r["featureId"]) for r in matched} == want and len(matched) == len(want)
    assert {r["specId"]: r["mass"] for r in matched} == {s[1]: s[2] for s in spectra if s[1] in want}
    assert len(want) > 5 and any(single for _, single, _ in want.values())


def test_dense_feature_matching_lists_no_pairs(spark):
    """Of 80,000 spectra each meets 80,000 features: 6.4e9 pairs, which joins don't make in this time."""
    one = spark.range(80_000).select(F.lit("r").alias("specfile"), F.col("id"), F.lit(500.0).alias("mass"), (F.col("id") % 7).cast("double").alias("rt"), F.lit(2).alias("charge"))
    feats = one.select("specfile", F.col("id").alias("featureId"), "mass", F.lit(0.0).alias("rtLow"), F.lit(9.0).alias("rtHigh"), "charge")
    began = time.monotonic()
    got = features.match_features(one.withColumnRenamed("id", "specId"), feats, 10e-6, isotope_errors=(0, 1)).groupBy("error", "single", "featureId").count().collect()
    assert [tuple(r) for r in got] == [(0.0, False, None, 80_000)] and time.monotonic() - began < 60


def plain_linkage(rows, limit):
    """Pairs by distance and positions, one by one; rows are (time, mass, category) in order. The first position of each row's group."""
    group = list(range(len(rows)))
    kinds = [{c} for _, _, c in rows]
    pairs = [(math.sqrt((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(rows), 2)]
    for d, i, j in sorted(pairs):
        a, b = sorted((group[i], group[j]))
        if d <= limit and a != b and not kinds[a] & kinds[b]:
            kinds[a] |= kinds[b]
            group = [a if g == b else g for g in group]
    return group


@pytest.mark.parametrize("limit, spread, kinds, few", [(5.0, 60, 4, 0), (3.0, 12, 9, 0), (0.0, 3, 3, 0), (40.0, 40, 60, 0), (5.0, 60, 4, 500), (3.0, 12, 9, 100_000)])
def test_proximity_equals_the_plain_program(spark, limit, spread, kinds, few, monkeypatch):
    """Random points, points on a lattice (ties), a dense island, and one category for each; by rounds, and with the last edges in one task."""
    monkeypatch.setattr(features, "FEW_EDGES", few)
    rng = np.random.default_rng(int(limit) + kinds)
    points = {g: [(float(t), float(m), f"c{rng.integers(kinds)}") for t, m in (rng.integers(0, spread, (60, 2)) if g == 2 or limit == 0 else rng.uniform(0, spread, (60, 2)))] for g in (1, 2, None)}
    table = spark.createDataFrame([(g, i, *row) for g, rows in points.items() for i, row in enumerate(rows)], "g int, i int, t double, m double, c string")
    got = {(r["g"], r["i"]): r["linkage"] for r in features.group_by_proximity(table.repartition(3), "t", "m", "c", limit, ["g"], ["i"]).collect()}
    for g, rows in points.items():
        assert [got[(g, i)] for i in range(len(rows))] == plain_linkage(rows, limit)


@pytest.mark.parametrize("few, kinds", [(0, 5), (100_000, 40)])
def test_proximity_in_steps_equals_the_plain_program(spark, few, kinds, monkeypatch):
    """Distances from a hundredth of the limit on, in islands of random points, of lattice points and of copies."""
    monkeypatch.setattr(features, "FEW_EDGES", few)
    monkeypatch.setattr(features, "FEW_PAIRS", 0.02)
    rng = np.random.default_rng(kinds)
    spots = {"random": rng.uniform(0, 20, (70, 2)), "lattice": rng.integers(0, 8, (70, 2)), None: rng.integers(0, 3, (70, 2)) * 4.0}
    points = {g: [(float(t), float(m), f"c{rng.integers(kinds)}") for t, m in own] for g, own in spots.items()}
    table = spark.createDataFrame([(g, i, *row) for g, rows in points.items() for i, row in enumerate(rows)], "g string, i int, t double, m double, c string")
    got = {(r["g"], r["i"]): r["linkage"] for r in features.group_by_proximity(table.repartition(3), "t", "m", "c", 9.0, ["g"], ["i"]).collect()}
    for g, rows in points.items():
        assert [got[(g, i)] for i in range(len(rows))] == plain_linkage(rows, 9.0)


def test_proximity_of_a_dense_island_keeps_few_pairs(spark, monkeypatch):
    """All of 20,000 points lie within the limit of all others, so any two groups that are left share a category."""
    kept = []
    counted = lambda groups, edges, rounds: kept.append(edges.count()) or linked(groups, edges, rounds)
    linked = features._linked
    monkeypatch.setattr(features, "_linked", counted)
    rng = np.random.default_rng(8)
    rows = [(i, float(t), float(m), int(i % 400)) for i, (t, m) in enumerate(rng.uniform(0, 10, (20_000, 2)))]
    table = spark.createDataFrame(rows, "i int, t double, m double, c int").withColumn("g", F.lit("x"))
    groups: dict = {}
    for r in features.group_by_proximity(table, "t", "m", "c", 20.0, ["g"], ["i"]).collect():
        groups.setdefault(r["linkage"], []).append(r["c"])
    kinds = [set(own) for own in groups.values()]
    assert all(len(own) == len(k) for own, k in zip(groups.values(), kinds)) and all(a & b for a, b in itertools.combinations(kinds, 2))
    assert sum(map(len, kinds)) == 20_000 and max(kept) < 400_000


def test_proximity_of_odd_rows(spark):
    table = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 1.0, 0.0, "b"), (3, 2.0, 0.0, "a"), (4, 50.0, 0.0, "a"), (5, None, 0.0, "b"), (6, 1.5, 0.0, None), (7, 1.5, 0.0, None)], "i int, t double, m double, c string").withColumn("g", F.lit("x"))
    got = {r["i"]: r["linkage"] for r in features.group_by_proximity(table, "t", "m", "c", 5.0, ["g"], ["i"]).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 3, 5: 4, 6: 1, 7: 0}
    assert features.group_by_proximity(table.limit(0), "t", "m", "c", 5.0, ["g"], ["i"]).count() == 0


def test_lfq_groups(spark):
    rows = [(run, f"{run}{i}", 2, 500.0 + i, 100.0 * i + shift, True, i == 1, 10.0 * i) for run, shift in (("a", 0.0), ("b", 3.0)) for i in (1, 2)]
    t = spark.createDataFrame(rows, "specfile string, id string, charge int, mz double, rt double, isValid boolean, isAnnotated boolean, intensity double")
    groups, members = features.lfq_groups(t)
    assert [(r["members"], r["isValid"]) for r in groups.collect()] == [(2, True)]
    assert {r["id"] for r in members.collect()} == {"a1", "b1"}
    wide = features.intensity_matrix(members, ["a", "b"]).first()
    assert (wide["a"], wide["b"]) == (10.0, 10.0)


def test_rt_alignment(spark):
    rows = [(run, f"{run}{i}", 2, 400.0 + i, 10.0 * i + (0.0 if run == "a" else 5.0), 1e6) for run in "ab" for i in range(200)]
    t = spark.createDataFrame(rows, "specfile string, id string, charge int, mz double, rt double, intensity double").withColumn("obsRt", F.lit(None).cast("double"))
    got = features.calibrate_rt(t, "a").where("specfile = 'b'").collect()
    assert max(abs(r["obsRt"] - r["rt"] - 5) for r in got) < 0.5


def plain_spline(x, y, window, cells, least, expansion, at):
    """Smooth, continue beyond both ends, and fit truncated powers, whose knots are borders of cells, to all points."""
    pairs = sorted(zip(x, y), key=lambda p: p[0])  # equal positions stay in the order of their ids
    middle = window - 1 - (window - 1) // 2
    smooth = [(pairs[i + middle][0], float(np.median([q for _, q in pairs[i : i + window]]))) for i in range(len(pairs) - window + 1)]
    (low, first), (high, last) = smooth[0], smooth[-1]
    reach = (high - low) * expansion
    for i in range(1, 101):
        smooth += [(low - reach * i / 100, first), (high + reach * i / 100, last)]
    start, width = low - reach, (high - low + 2 * reach) / cells
    placed = [((p - start) / width, q) for p, q in smooth]
    inside = lambda a, b: sum(a <= min(int(p), cells - 1) < b for p, _ in placed)
    knots = [0]
    for knot in range(1, cells):
        if inside(knots[-1], knot) >= least and inside(knot, cells) >= least:
            knots.append(knot)
    base = lambda u: [1, u, u * u] + [max(0.0, u - k) ** 2 for k in knots[1:]]
    c = np.linalg.lstsq(np.array([base(p / cells * cells) for p, _ in placed]), np.array([q for _, q in placed]), rcond=None)[0]
    return [float(np.dot(base(min(max((p - start) / width, 0), cells)), c)) for p in at], len(knots)


def test_splines_by_sums_equal_a_plain_fit(spark):
    rng = np.random.default_rng(5)
    data = {"many": rng.uniform(0, 300, 900).round(1), "gap": np.concatenate((rng.uniform(0, 40, 200), rng.uniform(250, 300, 60))).round(2), "few": rng.uniform(0, 9, 8), None: rng.uniform(-50, 50, 150)}
    curve = {g: (x, 3 * np.sin(x / 40) + rng.normal(0, 0.3, len(x))) for g, x in data.items()}
    rows = [(g, i, float(p), float(q)) for g, (x, y) in curve.items() for i, (p, q) in enumerate(zip(x, y))] + [("many", 9000, None, 1.0), ("many", 9001, 5.0, None), ("many", 9002, float("nan"), 2.0)]
    points = spark.createDataFrame(rows, "g string, id int, x double, y double").repartition(5)
    model = splines.fit(points, ["g"], "x", "y", ["id"], window=7, cells=40, cycles=1, share=1.0, least=12, expansion=0.1, fewest=20)
    asked = [(g, float(p)) for g in (*data, "unknown") for p in [-80, -1, 0, 3.3, 39, 100.5, 251, 299, 340]] + [("many", None)]
    got = {(r["g"], r["x"]): r["deviation"] for r in splines.predict(spark.createDataFrame(asked, "g string, x double"), model, ["g"], "x").collect()}
    assert len(got) == len(asked) and got["many", None] is None
    for g in ("few", "unknown"):
        assert all(v is None for (h, _), v in got.items() if h == g)
    for g in ("many", "gap", None):
        where = [p for h, p in asked if h == g and p is not None]
        want, knots = plain_spline(*curve[g], 7, 40, 12, 0.1, where)
        assert knots > 8
        # points in a gap are held by its ends alone
        some = [i for i, p in enumerate(where) if g != "gap" or not 45 < p < 245]
        assert [got[g, where[i]] for i in some] == pytest.approx([want[i] for i in some], abs=1e-3)


def test_splines_of_random_shares(spark):
    """The mean of splines of shares follows the trend; a position that all points share has their median."""
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 1000, 3000)
    rows = [("a", i, float(p), float(0.01 * p + e)) for i, (p, e) in enumerate(zip(x, rng.normal(0, 0.5, len(x))))] + [("b", i, 7.0, float(i % 3)) for i in range(60)]
    points = spark.createDataFrame(rows, "g string, id int, x double, y double")
    model = splines.fit(points, ["g"], "x", "y", ["id"], cells=50)
    at = spark.createDataFrame([("a", float(p)) for p in range(0, 1001, 50)] + [("b", -3.0), ("b", 7.0), ("b", 90.0)], "g string, x double")
    got = splines.predict(at, model, ["g"], "x").collect()
    assert max(abs(r["deviation"] - 0.01 * r["x"]) for r in got if r["g"] == "a") < 0.5
    assert [r["deviation"] for r in got if r["g"] == "b"] == pytest.approx([1.0] * 3, abs=1e-3)
    assert splines.predict(at, splines.fit(points.limit(0), ["g"], "x", "y", ["id"]), ["g"], "x").where("deviation is null").count() == len(got)


def test_rt_alignment_leaves_what_it_cannot_align(spark):
    """A drift that grows; a run of few matches, features without a time, known original times, further columns."""
    drift = lambda run, t: t if run == "a" else t + 2 + t / 400 if run == "b" else t + 9
    rows = [(run, f"{run}{i}", 2, 400.0 + i, drift(run, 10.0 * i), 1e6, None, "x") for run in "abc" for i in range(200 if run < "c" else 30)]
    rows += [("b", "none", 2, 900.0, None, 1e6, None, "y"), ("b", "known", 2, 950.0, 1000.0, 1.0, 77.0, "z")]
    t = spark.createDataFrame(rows, "specfile string, id string, charge int, mz double, rt double, intensity double, obsRt double, note string")
    out = features.calibrate_rt(t, "a")
    assert out.columns == t.columns and "cogroup" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for run, i, _, _, rt, _, known, note in rows:
        r = got[i]
        assert r["note"] == note and r["obsRt"] == (known if known is not None else rt)
        if rt is None or run != "b":
            assert r["rt"] == rt
        else:
            # the deviation is one of the observed time
            assert abs(r["rt"] - (rt - 2) / (1 + 1 / 400)) < 0.3


def test_islands(spark):
    t = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 1.5, 3.0, 3.2, 9.0])], "id int, v double").withColumn("g", F.lit(1))
    assert [r["island"] for r in windows.islands(t, "v", 1.0, ["id"], ["g"]).orderBy("v").collect()] == [0, 0, 1, 1, 2]


@pytest.fixture(scope="module")
def values(spark):
    """A group of most rows, small groups, a null group, nulls and many equal values."""
    rng = np.random.default_rng(8)
    rows = [(g, i, None if x % 17 == 3 else float(x)) for i, (g, x) in enumerate(zip(rng.choice([1, 1, 1, 1, 2, 3, None], 700).tolist(), rng.integers(0, 400, 700).tolist()))]
    rows = [(g if g is None else int(g), i, v) for g, i, v in rows] + [(9, 1000, 5.0)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small tables keep several ranges
    yield rows, spark.createDataFrame(rows, "g int, id int, v double").repartition(3)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def in_order(rows):
    """Rows of each group by value, nulls first, and id."""
    groups: dict = {}
    for g, i, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0.0, r[1])):
        groups.setdefault(g, []).append((i, v))
    return groups


def test_numbers_and_islands_across_ranges(spark, values):
    rows, table = values
    parts = ordered.ranges(table, ["g"], ["v", "id"])
    assert parts.where("g = 1").select("_part").distinct().count() > 1
    numbers = {r["id"]: r["position"] for r in ordered.numbered(table, ["g"], ["v", "id"]).collect()}
    everywhere = {r["id"]: r["position"] for r in ordered.numbered(table, [], ["id"]).collect()}
    islands = {r["id"]: r["island"] for r in ordered.islands(table, "v", 1.0, ["id"], ["g"]).collect()}
    assert everywhere == {i: n for n, i in enumerate(sorted(r[1] for r in rows))}
    for own in in_order(rows).values():
        island, last = 0, None
        for n, (i, v) in enumerate(own):
            island += v is not None and last is not None and v - last > 1.0
            last = v if v is not None else last
            assert (numbers[i], islands[i]) == (n, island)
    assert ordered.numbered(table.limit(0), ["g"], ["v"]).count() == ordered.islands(table.limit(0), "v", 1.0, ["id"], ["g"]).count() == 0


@pytest.mark.parametrize("block, m, kind, by", [(8, 5, "mean", ["g"]), (3, 7, "median", ["g"]), (16, 1, "mean", []), (10, 10, "median", [])])
def test_running_values_across_blocks(spark, values, block, m, kind, by, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", block)
    rows, table = values
    got = {r["id"]: r["running"] for r in ordered.running(table.na.fill(0.5, ["v"]), "v", m, ["id"], by, kind).collect()}
    want = {}
    groups: dict = {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        own = groups.setdefault(g if by else 0, [])
        own.append(0.5 if v is None else v)
        if len(own) >= m:
            want[i] = float(np.mean(own[-m:]) if kind == "mean" else np.median(own[-m:]))
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_bounds_of_positions(spark):
    rng = np.random.default_rng(4)
    right = [(i, float(v)) for i, v in enumerate(rng.integers(90, 110, 300) / 1.0)]
    left = [(i, float(v)) for i, v in enumerate(rng.uniform(85, 115, 40))]
    got = {r["k"]: (r["low"], r["high"]) for r in rangejoin.bounds_within(spark.createDataFrame(left, "k int, x double"), spark.createDataFrame(right, "id int, y double"), ["k"], "x", "y", 0.02, "relative", ["id"]).collect()}
    ordered_values = sorted(v for _, v in right)
    for k, x in left:
        near = [n for n, v in enumerate(ordered_values) if x - x * 0.02 <= v <= x + x * 0.02]
        assert got[k] == ((near[0], near[-1] + 1) if near else (None, None))


def test_protein_database(spark):
    t = spark.createDataFrame([("P1", "AAAKCCCKDDD"), ("P2", "AAAKEEE"), ("P3", "")], "id string, sequence string")
    edges = proteins.peptides_of(t, "[K]", least=3)
    assert {r["peptide"]: r["isUnique"] for r in proteins.peptide_table(edges).collect()} == {"AAAK": False, "CCCK": True, "DDD": True, "EEE": True}
    got = {r["id"]: (r["length"], r["coveredUnique"], r["coveredShared"]) for r in proteins.coverage(t, edges).collect()}
    assert got == {"P1": (11, 7, 4), "P2": (7, 3, 4), "P3": (0, 0, 0)}
    mask = {r["id"]: r["mask"] for r in proteins.coverage_mask(t, edges).collect()}
    assert mask["P2"] == [False] * 4 + [True] * 3


def test_targets_of_matches(spark):
    scans = spark.createDataFrame([("r", f"s{i}", float(i)) for i in range(3)], "specfile string, id string, rt double")
    psms = spark.createDataFrame([("r", "s0", 500.1, 500.0), ("r", "s2", 600.1, 600.0)], "specfile string, precursorId string, obsMz double, excMz double")
    got = {(r["id"], r["excMz"]) for r in calibration.calibration_targets(scans, psms).collect()}
    assert got == {("s0", 500.0), ("s1", 500.0), ("s1", 600.0), ("s2", 600.0)}


def test_tangled_boxes_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    boxes = [(i, i % 2, *(float(x) for a in (0, 1) for x in sorted(rng.uniform(0, 60) + rng.exponential(2, 2)))) for i in range(60)]
    table = spark.createDataFrame(boxes, "key int, g int, tMin double, tMax double, mMin double, mMax double")
    meet = lambda a, b: a[0] != b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5]
    want = {a[0] for a in boxes if any(meet(a, b) for b in boxes)}
    assert 5 < len(want) < 60 and {r["key"] for r in features.tangled(table, "key", ["g"]).collect()} == want


def test_time_medians(spark):
    scans = spark.createDataFrame([("r", str(i), float(i)) for i in range(3)], "specfile string, id string, rt double")
    data = spark.createDataFrame([("r", "0", 1.0), ("r", "1", 4.0)], "specfile string, id string, relDev double")
    got = {r["id"]: r["correction"] for r in calibration.time_medians(scans, data, 5).collect()}
    assert got["0"] == pytest.approx((1 + 0.5 * 4) / 1.5) and got["2"] == pytest.approx(2.5)


def expanded(med, n, least):
    """Windows grown step by step on both sides."""
    out = np.full(len(n), np.nan)
    for i in range(len(n)):
        own, step = [i], 0
        while n[own].sum() < least and len(own) < len(n):
            step += 1
            own = list(range(max(0, i - step), min(len(n), i + step + 1)))
        used = [(med[j], 1.0 if j == i else 0.5) for j in own if n[j]]
        if used:
            out[i] = sum(m * w for m, w in used) / sum(w for _, w in used)
    return out


def test_weighted_medians_equal_windows_grown_step_by_step():
    rng = np.random.default_rng(8)
    for size in [0, 1, 2, *rng.integers(3, 40, 200)]:
        n = rng.integers(0, 6, size) * (rng.random(size) < rng.random())
        med = np.where(n > 0, rng.normal(size=size), np.nan)
        for least in (0, 1, 7, 1000):
            np.testing.assert_allclose(calibration.weighted_medians(med, n, least), expanded(med, n, least), atol=1e-12)
    many = np.ones(500_000, int)
    assert np.allclose(calibration.weighted_medians(np.full(500_000, 3.0), many, 10**7), 3)


def test_time_medians_of_ties_and_nulls(spark):
    scans = spark.createDataFrame([("r", "b", 1.0), ("r", "a", 1.0), ("s", "x", 2.0)], "specfile string, id string, rt double")
    data = spark.createDataFrame([("r", "a", 2.0), ("r", "a", None), ("s", "x", None)], "specfile string, id string, relDev double")
    got = {r["id"]: r["correction"] for r in calibration.time_medians(scans, data, 1).collect()}
    assert got == {"a": 2.0, "b": 2.0, "x": None}
    assert calibration.time_medians(scans.limit(0), data, 1).count() == 0


def test_first_valid_and_named(spark):
    rows = [("a", "s1", 2, True, "late"), ("a", "s1", 0, False, "invalid"), ("a", "s1", 1, True, "first"), ("b", "s1", 0, True, "other run"), ("a", "s2", 0, False, "none"), ("a", "s3", 0, None, "unknown")]
    t = spark.createDataFrame(rows, "specfile string, id string, ord int, isValid boolean, note string").repartition(3)
    notes = lambda df: [r["note"] for r in df.collect()]
    assert notes(access.first_valid(t, "a", "s1")) == ["first"] and sorted(notes(access.item(t, "a", "s1"))) == ["first", "invalid", "late"]
    assert notes(access.first_valid(t, "a", "s2")) == notes(access.first_valid(t, "a", "s3")) == notes(access.first_valid(t, "c", "s1")) == []
    proteins_ = spark.createDataFrame([("P1", "ALBU"), ("P2", "P1"), ("P3", "KRT"), ("P0", "KRT"), (None, None)], "id string, name string")
    found = lambda key: [r["id"] for r in access.by_id_or_name(proteins_, key).collect()]
    # an id comes before a name, and of equal names the least id
    assert [found(k) for k in ("P1", "ALBU", "KRT", "nothing")] == [["P1"], ["P1"], ["P0"], []]


def test_annotated_features(spark):
    fs = spark.createDataFrame([("a", "f1", 5), ("a", "f2", 6), ("a", "f3", 7), ("b", "f1", 8)], "specfile string, id string, extra int")
    # f2 is met, but not by a spectrum of one peptide; a spectrum that meets several features matches none
    met = spark.createDataFrame([("a", "s1", "f1", True), ("a", "s2", "f1", True), ("a", "s3", "f2", True), ("a", "s4", "f3", False), ("a", "s4", "f2", False)], "specfile string, specId string, featureId string, single boolean")
    best = spark.createDataFrame([("a", "f1", ["s1", "s2"], 0.01, "PEPK[x]", "PEPK")], "specfile string, featureId string, specIds array<string>, score double, peptide string, sequence string")
    out = features.annotate_features(fs, met, best)
    got = {(r["specfile"], r["id"]): r for r in out.collect()}
    assert len(got) == 4 and {k: (r["isMatched"], r["isAnnotated"], r["peptide"], r["score"], r["siiIds"], r["extra"]) for k, r in got.items()} == {
        ("a", "f1"): (True, True, "PEPK[x]", 0.01, ["s1", "s2"], 5), ("a", "f2"): (True, False, None, None, [], 6), ("a", "f3"): (False, False, None, None, [], 7), ("b", "f1"): (False, False, None, None, [], 8),
    }
    spectra = spark.createDataFrame([(f"s{i}",) for i in range(8)], "specId string")
    # features of two runs may have one id
    both = met.unionAll(spark.createDataFrame([("b", "s9", "f1", True)], met.schema))
    assert features.match_statistics(fs, both, spectra).first()["matched_features"] == 3
    assert features.match_statistics(fs, met, spectra).collect()[0].asDict() == {"features": 4, "spectra": 8, "matched_features": 2, "matched_spectra": 3, "feature_share": 0.5, "spectrum_share": 0.375}
    nothing = features.match_statistics(fs.limit(0), met.limit(0), spectra.limit(0)).collect()[0]
    assert (nothing["features"], nothing["matched_spectra"], nothing["feature_share"], nothing["spectrum_share"]) == (0, 0, None, None)
    bare = {(r["specfile"], r["id"]): r for r in access.remove_annotation(out, ["a"]).collect()}
    assert len(bare) == 4 and all((r["isMatched"], r["isAnnotated"], r["peptide"], r["siiIds"], r["score"]) == (False, False, None, None, None) for k, r in bare.items() if k[0] == "a")
    assert bare["b", "f1"] == got["b", "f1"] and access.remove_annotation(out).where("siiIds is not null").count() == 0


def test_annotated_groups(spark):
    rows = [(1, True, 0.2, "A[x]", "A"), (1, True, 0.9, "B", "B"), (1, False, 0.01, "C", "C"), (2, True, 0.5, "D", "D"), (2, True, 0.5, "E", "E"), (3, False, None, None, None), (4, None, 1.0, "F", "F")]
    members = spark.createDataFrame(rows, "groupId int, isAnnotated boolean, score double, peptide string, sequence string")
    found = lambda larger: {r["groupId"]: (r["score"], r["peptide"], r["sequence"]) for r in features.annotate_groups(members, larger).collect()}
    assert found(True) == {1: (0.9, "B", "B"), 2: (0.5, "E", "E")} and found(False) == {1: (0.2, "A[x]", "A"), 2: (0.5, "D", "D")}


@pytest.mark.parametrize("mode", ["relative", "absolute"])
def test_mass_model(spark, mode):
    from spectrel.functions.numerics import DeviationModel

    x = np.linspace(300, 1200, 600)
    model = DeviationModel(1e-6 * x / 100, x, knots=5)
    mz = [300.5, 700.25, 1100.0, 5000.0]
    rows = [(1, 1, mz), (2, 2, mz), (3, 1, []), (4, 1, None), (5, None, mz)]
    t = spark.createDataFrame(rows, "i int, msLevel int, mz array<double>")
    got = {r["i"]: r["mz"] for r in calibration.apply_mass_model(t, model, mode).collect()}
    moved = [m * (1 + d) if mode == "relative" else m + d for m, d in zip(mz, model(mz))]
    assert got[1] == pytest.approx(moved, rel=1e-12) and got[1] != mz and got[2] == got[5] == mz and got[3] == [] and got[4] is None
    # away from the ends, beyond which the deviation is taken as constant, it is the trend
    assert model(mz[1])[0] == pytest.approx(1e-6 * mz[1] / 100, abs=2e-8)
