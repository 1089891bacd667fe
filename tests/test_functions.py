import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectrel import constants
from spectrel.functions import isobaric, labels, masses, numerics, sequences

PROTEIN = "MGTKWQEERDLNSSKRIVGHAYPTKKLMEDQNCFRSTWPGAEKHLLVNDRYISKMGTKWQE"


def cut(protein, rule, missed, start_m, least, most):
    found = sequences.digested(pa.array([None, protein, ""]), constants.CLEAVAGE_RULES.get(rule, rule), missed, start_m, least, most).to_pylist()
    assert found[0] == found[2] == [] and [p["ord"] for p in found[1]] == list(range(len(found[1])))
    return [(p["sequence"], p["startPos"], p["endPos"], p["missedCleavage"]) for p in found[1]]


def plain_digest(protein, pattern, missed, start_m, least, most):
    """Each protein on its own: peptides after the first M's removal, those of the start, the others."""
    ends = sorted({m.end() for m in re.finditer(pattern, protein)} | {len(protein)} - {0})
    ends = [e for e in ends if e]
    spans = [(1, b, m) for m, b in enumerate(ends[: missed + 1])] if start_m and protein[:1] == "M" else []
    for i, a in enumerate([0, *ends[:-1]][: len(ends)]):
        spans += [(a, b, m) for m, b in enumerate(ends[i : i + missed + 1])]
    return [(protein[a:b], a + 1, b, m) for a, b, m in spans if least <= b - a <= most]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def plain_mass(peptide):
    """Elements counted letter by letter."""
    elements = Counter({"H": 2, "O": 1})
    for mod, residue in re.findall(r"\[([^\]]*)\]|(.)", peptide):
        elements.update(constants.RESIDUE_COMPOSITIONS[residue] if residue else constants.MODIFICATION_COMPOSITIONS[mod.replace("UNIMOD:", "u:")])
    return sum(constants.ELEMENTS[e] * n for e, n in elements.items())


@pytest.mark.parametrize("charge", [1, 2, 5])
def test_mass_arithmetic(spark, charge):
    mass, z = plain_mass("GLVEHKWQ"), F.lit(charge)
    mz, mh = (mass + charge * constants.PROTON) / charge, mass + constants.PROTON
    assert one(spark, masses.mz_from_mass(F.lit(mass), z)) == pytest.approx(mz)
    assert one(spark, masses.mass_from_mz(F.lit(mz), z)) == pytest.approx(mass)
    assert one(spark, masses.mh_from_mz(F.lit(mz), z)) == pytest.approx(mh)
    assert one(spark, masses.mz_from_mh(F.lit(mh), z)) == pytest.approx(mz)


@pytest.mark.parametrize("peptide", ["GLVEHK", "M[UNIMOD:35]QNWFPYC[UNIMOD:4]R", "[UNIMOD:5]TVDK[u:188]GSIR", "G"])
def test_peptide_mass(spark, peptide):
    assert one(spark, masses.peptide_mass(F.lit(peptide))) == pytest.approx(plain_mass(peptide), abs=1e-9)


def test_unknown_residue_is_an_error(spark):
    with pytest.raises(Exception, match="unknown residue"):
        one(spark, masses.peptide_mass(F.lit("AXB")))


def test_constants():
    assert constants.RESIDUE_MASSES["G"] == pytest.approx(plain_mass("G") - constants.WATER)
    assert constants.MODIFICATION_MASSES["u:34"] == pytest.approx(12 + 2 * constants.ELEMENTS["H"])
    assert len(constants.CLEAVAGE_RULES) == 35


def test_modifications(spark):
    peptide = F.lit("[UNIMOD:5]GEK[BS3]VS[UNIMOD:35]M[UNIMOD:35]R")
    assert one(spark, masses.strip_modifications(peptide)) == "GEKVSMR"
    assert one(spark, sequences.modification_positions(peptide)) == {"5": [1], "BS3": [3], "35": [5, 6]}
    assert one(spark, sequences.modification_positions(peptide, 11)) == {"5": [11], "BS3": [13], "35": [15, 16]}


def test_substrings(spark):
    for text, part in (("GVGVGLKGVG", "GVG"), ("KKKK", "KK"), ("LEV", "LEVR"), ("LEV", "W")):
        assert one(spark, sequences.all_substrings(F.lit(text), F.lit(part))) == [i for i in range(len(text)) if text[i : i + len(part)] == part]


def plainly_cut(protein, letters, missed, start_m, least, most):
    """All joins of up to ``missed`` + 1 neighbouring pieces that end with one of the letters, without a dictionary or expression."""
    ends = [i + 1 for i, c in enumerate(protein) if c in letters and i + 1 < len(protein)] + [len(protein)]
    starts = [0, *ends[:-1]]
    out = set()
    for i, a in enumerate(starts):
        for k, b in enumerate(ends[i : i + missed + 1]):
            out.add((protein[a:b], a + 1, b, k))
            if start_m and a == 0 and protein[:1] == "M":
                out.add((protein[1:b], 2, b, k))
    return {p for p in out if least <= len(p[0]) <= most}


@pytest.mark.parametrize("letters", ["R", "K", "KR"])
@pytest.mark.parametrize("missed,start_m,least,most", [(0, False, 1, 1000), (1, False, 4, 9), (2, False, 1, 30), (1, True, 3, 12)])
def test_digest_cases(letters, missed, start_m, least, most):
    got = cut(PROTEIN, f"[{letters}]", missed, start_m, least, most)
    want = plainly_cut(PROTEIN, letters, missed, start_m, least, most)
    assert set(got) == want and len(got) == len(want)


def test_digest_before_a_letter():
    found = [p[0] for p in cut("GGSPRAAK", r"\w(?=[R])", 0, False, 1, 1000)]
    assert found == ["GGSP", "RAAK"] and cut("", "[K]", 1, True, 1, 9) == []


def test_digest_column(spark):
    rows = spark.createDataFrame([(1, "AAKCCKDD"), (2, None), (3, "")], "id int, s string").select("id", sequences.digest(F.col("s"), "[K]", 1, False, 5, 6).alias("p")).collect()
    assert {r["id"]: [x["sequence"] for x in r["p"]] for r in rows} == {1: ["AAKCCK", "CCKDD"], 2: [], 3: []}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("KRMAPé", max_size=30), max_size=6), st.integers(0, 3), st.booleans(), st.sampled_from(["[KR]", "K", "trypsin", "arg-c", r"\w(?=[R])", "(?<=K)", "[^P]"]))
def test_digest_of_a_batch_equals_the_plain_one(proteins, missed, start_m, rule):
    pattern = constants.CLEAVAGE_RULES.get(rule, rule)
    found = sequences.digested(pa.array(proteins, pa.string()), pattern, missed, start_m, 2, 12).to_pylist()
    want = [plain_digest(p, pattern, missed, start_m, 2, 12) for p in proteins]
    assert [[(x["sequence"], x["startPos"], x["endPos"], x["missedCleavage"]) for x in own] for own in found] == want


@settings(max_examples=60, deadline=None)
@given(st.text("KRMAP", max_size=40), st.integers(0, 3))
def test_digest_pieces_are_of_the_protein(protein, missed):
    for sequence, start, end, n in cut(protein, "trypsin", missed, True, 1, 100):
        assert protein[start - 1 : end] == sequence and n <= missed


STATES = [({"K": "", "M": ""}, {}), ({"K": "u:34"}, {}), ({"nTerm": "u:5", "K": ["u:34", "u:5"]}, {"u:1": "u:5"}), ({"nTerm": "u:121", "K": "u:121"}, {"u:1": "u:121"})]


def setup(states=STATES):
    s = labels.LabelSetup()
    for rules in states:
        s.add(*rules)
    return s


def plain_labels(peptide, states):
    """What is at each place, and what each state expects there, as counts of (place, label)."""
    sequence, mods = "", Counter()
    for mod, residue in re.findall(r"\[([^\]]*)\]|(.)", peptide):
        sequence += residue
        if mod:
            mods[max(0, len(sequence) - 1), mod] += 1
    expected = []
    for rules, excluding in states:
        want = Counter()
        for i, residue in enumerate(sequence):
            for place, symbols in rules.items():
                if place == residue or place == "nTerm" and i == 0:
                    want.update((i, s) for s in ([symbols] if isinstance(symbols, str) else symbols) if s)
        want.subtract((i, excluding[m]) for i, m in mods.elements() if m in excluding and want[i, excluding[m]])
        expected.append(+want)
    used = {s for want in expected for _, s in want} | {"u:34", "u:5", "u:121"}
    return sequence, Counter({k: n for k, n in mods.items() if k[1] in used}), expected


def plain_state(peptide, states):
    sequence, seen, expected = plain_labels(peptide, states)
    if not any(r in sequence for rules, _ in states for r in rules) and not any("nTerm" in rules for rules, _ in states):
        return -1
    fits = [i for i, want in enumerate(expected) if want == seen]
    alike = any(a == b for i, a in enumerate(expected) for b in expected[:i])
    return -2 if not fits else -3 if alike else fits[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("KMGL", min_size=1, max_size=7), st.integers(0, 3), st.booleans(), st.booleans(), st.booleans())
def test_label_states_equal_the_plain_ones(sequence, state, acetyl, lose, plain):
    states = STATES[:2] if plain else STATES
    state %= len(states)
    mods = ["u:1"] if acetyl else []
    want = plain_labels("[u:1]" * acetyl + sequence, states)[2][state]
    if lose and want:
        want -= Counter([min(want)])
    text = "".join(f"[{m}]" for m in mods)
    for i, residue in enumerate(sequence):
        text += residue + "".join(f"[{s}]" for (at, s) in want.elements() if at == i)
    got, number = labels.label_state(text, setup(states)), plain_state(text, states)
    assert got == number
    if number >= 0:
        masses_of = [sum(constants.MODIFICATION_MASSES[s] for _, s in w.elements()) for w in plain_labels(text, states)[2]]
        assert labels.mass_differences(text, setup(states)) == pytest.approx({i: m - masses_of[number] for i, m in enumerate(masses_of) if i != number})
    else:
        assert labels.mass_differences(text, setup(states)) == {}


@pytest.mark.parametrize("peptide,state", [("GKLMK", 0), ("GK[u:34]LMK[u:34]", 1), ("G[u:5]K[u:5][u:34]L", 2), ("GK[u:34]LMK", -2), ("[u:1]GLM", -3)])
def test_label_states(peptide, state):
    assert labels.label_state(peptide, setup()) == state == plain_state(peptide, STATES)


def test_labels_without_residues(spark):
    assert labels.label_state("GLVE", setup(STATES[:2])) == -1
    rows = spark.createDataFrame([(1, "GK[u:34]LM"), (2, None), (3, "GKLM")], "id int, p string")
    got = {r["id"]: r for r in rows.select("id", labels.label_state_column(F.col("p"), setup()).alias("s"), labels.mass_differences_column(F.col("p"), setup()).alias("d")).collect()}
    assert {i: r["s"] for i, r in got.items()} == {1: 1, 2: None, 3: 0}
    assert got[2]["d"] is None and got[3]["d"] == pytest.approx(labels.mass_differences("GKLM", setup()))


def test_label_columns_equal_the_functions(spark):
    """Random peptides of labels and other modifications, some twice, stray brackets, empty and null rows; several setups."""
    rng = np.random.default_rng(12)
    marks = ["", "", "", "[u:34]", "[u:5]", "[u:1]", "[u:1][u:1]", "[u:5][u:34]", "[u:21]", "[", "]", "[]"]
    peptides = [str(rng.choice(marks)) + "".join(a + str(rng.choice(marks)) for a in rng.choice(list("KMGLR"), rng.integers(0, 7))) for _ in range(1500)]
    peptides += ["", None, "K" * 3000 + "[u:34]", "[u:1]", "KK[u:34]", "K\nK"]
    # states of several places, labels twice at a place, longer text as a place, an end that is never found, states that look alike, none at all
    more = labels.LabelSetup()
    more.add({"nTerm": ["u:5", "u:34"], "KK": "u:34", "K": ["u:34", "u:34"]}, {"u:1": "u:34", "u:21": "u:34"})
    more.add({"K": "u:5", "cTerm": "u:34"})
    more.add({"K": [None], "": None})
    alike = labels.LabelSetup()
    alike.add({"R": "u:34"})
    alike.add({"R": "u:34", "K": None})
    table = spark.createDataFrame(list(enumerate(peptides)), "i int, p string").repartition(4)
    for own in (setup(STATES), setup(STATES[:2]), more, alike, labels.LabelSetup()):
        columns = {"s": labels.label_state_column(F.col("p"), own), "d": labels.mass_differences_column(F.col("p"), own)}
        found = table.select("i", *[c.alias(name) for name, c in columns.items()])
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r["i"]: (r["s"], r["d"]) for r in found.collect()}
        assert len(got) == len(peptides)
        for i, peptide in enumerate(peptides):
            state, apart = got[i]
            if peptide is None:
                assert state is None and apart is None
            else:
                assert state == labels.label_state(peptide, own), peptide
                assert apart == pytest.approx(labels.mass_differences(peptide, own)), peptide
    odd = labels.LabelSetup()
    odd.add({"K": "no such label"})
    with pytest.raises(ValueError):
        labels.mass_differences_column(F.col("p"), odd)


def test_reporters(spark):
    targets, tolerance = [113.1, 114.1, 115.1, 121.2], 20e-6
    mz = [90.0, 113.0985, 113.1001, 113.1006, 114.0, 115.1022, 115.1024, 121.2, 300.0]
    i = [7.0, 3.0, 41.0, 9.0, 5.0, 12.0, 8.0, 30.0, 1.0]
    row = spark.createDataFrame([(mz, i)], "mz array<double>, i array<double>")
    got = row.select(isobaric.reporter_ions(F.col("mz"), F.col("i"), targets, tolerance).alias("r")).first()["r"]
    for found, target in zip(got, targets):
        near = [(abs(m - target), k) for k, m in enumerate(mz) if abs(m - target) <= target * tolerance]
        assert found["i"] == (i[min(near)[1]] if near else 0) and (not near) == np.isnan(found["mz"])
    assert [x["i"] for x in got] == [41, 0, 12, 30]


def test_impurities():
    shares = [[0.04, 0.93, 0.03], [0.0, 0.98, 0.02], [0.01, 0.94, 0.05]]
    columns = np.array(isobaric.padded(shares, 1, 1)).T
    # a share one channel down or up lands there, and is lost beyond both ends
    assert columns.tolist() == [[0.93, 0.0, 0.0], [0.03, 0.98, 0.01], [0.0, 0.02, 0.94]]
    true = np.array([250.0, 0.0, 40.0])
    assert numerics.nnls(columns, columns @ true) == pytest.approx(true, abs=1e-9)
    assert [sum(r) for r in isobaric.normalized([[2, 6], [5, 5]])] == [1, 1]
    with pytest.raises(ValueError):
        isobaric.tmt("TMT6plex").matrix  # noqa: B018


def test_itraq_of_eight_channels():
    """The channel of the immonium ion takes part, so there are nine."""
    true = np.array([5.0, 0.0, 70.0, 12.0, 33.0, 0.0, 8.0, 3.0, 1.0])
    tag = isobaric.ITRAQ8
    assert tag.matrix.shape == (9, 9) and len(tag.reporters) == len(tag.labels) == 9
    assert (tag.matrix.sum(axis=0) <= 1 + 1e-12).all() and tag.matrix[0].sum() == pytest.approx(0.9287 + 0.0094)
    assert tag.corrected(tag.matrix @ true) == pytest.approx(true, abs=1e-8)


def test_impurities_stay_in_their_series():
    lot = [[0.0, 0.0, 95.0, 5.0, 0.0]] + [[1.0, 2.0, 93.0, 3.0, 1.0]] * 9
    tag = isobaric.tmt("TMT10plex", impurities=tuple(map(tuple, lot)))
    share = {(a, b): x for j, a in enumerate(tag.labels) for b, x in zip(tag.labels, tag.matrix[:, j]) if x}
    assert share["126", "127C"] == 0.05 and share["127N", "128N"] == 0.03 and share["127N", "129N"] == 0.01 and share["129C", "128C"] == 0.02 and share["131", "129N"] == 0.01
    heavy = lambda name: "C" if name == "126" or name.endswith("C") else "N"
    assert all(heavy(a) == heavy(b) for a, b in share)
    true = np.arange(1.0, 11.0)
    assert tag.corrected(tag.matrix @ true) == pytest.approx(true)
    with pytest.raises(ValueError):
        isobaric.tmt("TMT10plex", impurities=tuple(map(tuple, lot[:6])))


@pytest.mark.parametrize("m", [1, 4, 7])
def test_running_averages(m):
    x = np.random.default_rng(4).normal(size=30).round(2)
    windows = [sorted(x[i : i + m]) for i in range(len(x) - m + 1)]
    assert numerics.running_mean(x, m) == pytest.approx([sum(w) / m for w in windows])
    assert numerics.running_median(x, m) == pytest.approx([(w[(m - 1) // 2] + w[m // 2]) / 2 for w in windows])


def test_log_factorial(spark):
    assert one(spark, masses.log10_factorial(F.lit(6))) == pytest.approx(np.log10(720), abs=1e-6)


def test_deviation_model_follows_a_trend():
    x = np.linspace(0, 1000, 2000)
    y = 0.01 * x + np.random.default_rng(3).normal(0, 0.5, len(x))
    model = numerics.DeviationModel(y, x, "median", 10, knots=50)
    assert np.abs(model(x[100:-100]) - 0.01 * x[100:-100]).max() < 1


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_nnls_meets_its_conditions(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(6, 4)), rng.normal(size=6)
    x = numerics.nnls(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gain <= 1e-7).all() and np.abs(gain[x > 1e-9]).max(initial=0) < 1e-7


def test_nnls_of_rows_equals_that_of_each():
    rng = np.random.default_rng(2)
    a = np.abs(rng.normal(size=(6, 4)))
    rows = np.concatenate((rng.normal(size=(40, 6)), np.abs(rng.normal(size=(40, 4))) @ a.T))
    want = np.array([numerics.nnls(a, r) for r in rows])
    assert np.allclose(numerics.nnls_rows(a, rows), want, atol=1e-9) and (want == 0).any() and numerics.nnls_rows(a, rows[:0]).shape == (0, 4)
    flat = np.ones((3, 2))
    assert np.allclose(flat @ numerics.nnls_rows(flat, np.array([[1.0, 2.0, 3.0]]))[0], 2)


def test_corrected_column_of_odd_rows(spark):
    rows = [(1, [10.0, 5.0, 0.0, 1.0]), (2, None), (3, [0.0, 9.0, 0.0, 0.0])]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, "i int, v array<double>").coalesce(1).select("i", isobaric.corrected_column(F.col("v"), isobaric.ITRAQ4).alias("c")).collect()}
    assert got[2] is None and all(got[i] == pytest.approx(list(isobaric.ITRAQ4.corrected(v))) for i, v in rows if v)
