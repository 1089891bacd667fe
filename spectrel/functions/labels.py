"""Isotopic label states of peptides: column expressions over a small configuration, and the same for one peptide."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants


def _listed(x) -> list:
    return list(x) if isinstance(x, (list, tuple, set)) else [x]


@dataclass
class LabelSetup:
    """Label states 0, 1, ...: for each the residues (or nTerm) with their labels, and labels that other modifications exclude."""

    states: dict[int, tuple[dict, dict]] = field(default_factory=dict)

    def add(self, labels: dict, excluding: dict | None = None) -> int:
        self.states[len(self.states)] = (labels, excluding or {})
        return len(self.states) - 1

    @property
    def symbols(self) -> set[str]:
        return {s for labels, _ in self.states.values() for x in labels.values() for s in _listed(x) if s}

    @property
    def residues(self) -> set[str]:
        return {r for labels, _ in self.states.values() for r in labels if r}


def _read(peptide: str) -> tuple[str, dict[str, list[int]]]:
    sequence, mods = "", {}
    for token in re.findall(r"\[[^\]]*\]|[^\[\]]", peptide):
        if token[0] == "[":
            mods.setdefault(token[1:-1], []).append(max(0, len(sequence) - 1))
        else:
            sequence += token
    return sequence, mods


def expected_labels(sequence: str, mods: dict[str, list[int]], labels: dict, excluding: dict) -> dict[int, list[str]]:
    """Position to sorted labels of one state. A terminus other than nTerm is looked for as text, so cTerm labels never apply."""
    found: dict[int, list[str]] = {}
    for place, symbols in labels.items():
        symbols = [s for s in _listed(symbols) if s]
        if not symbols:
            continue
        for at in [0] if place == "nTerm" else [m.start() for m in re.finditer(f"(?={re.escape(place)})", sequence)]:
            found.setdefault(at, []).extend(symbols)
    for other, symbol in excluding.items():
        for at in mods.get(other, []):
            if symbol in found.get(at, []):
                found[at].remove(symbol)
                if not found[at]:
                    del found[at]
    return {at: sorted(symbols) for at, symbols in found.items()}


def label_state(peptide: str, setup: LabelSetup) -> int:
    """The state; -1: nothing to label, -2: fits no state, -3: fits one, but some states look alike."""
    sequence, mods = _read(peptide)
    residues = setup.residues
    if not any(r in sequence for r in residues) and not residues & {"nTerm", "cTerm"}:
        return -1
    seen: dict[int, list[str]] = {}
    for symbol in setup.symbols:
        for at in mods.get(symbol, []):
            seen[at] = sorted([*seen.get(at, []), symbol])
    expected = {state: expected_labels(sequence, mods, *rules) for state, rules in setup.states.items()}
    fits = [state for state, labels in expected.items() if labels == seen]
    if not fits:
        return -2
    return -3 if any(expected[a] == expected[b] for a, b in combinations(expected, 2)) else fits[-1]


def mass_differences(peptide: str, setup: LabelSetup, state: int | None = None) -> dict[int, float]:
    """Mass difference to each other state; none for peptides without a state."""
    state = label_state(peptide, setup) if state is None else state
    if state < 0:
        return {}
    sequence, mods = _read(peptide)
    masses = {s: sum(constants.MODIFICATION_MASSES[x] for labels in expected_labels(sequence, mods, *rules).values() for x in labels) for s, rules in setup.states.items()}
    return {s: m - masses[state] for s, m in masses.items() if s != state}


# ---------------------------------------------------------------- columns


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _label(at: Column, symbol: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), symbol.alias("symbol"))


def _parsed(peptide: Column) -> Column:
    """(sequence, mods): residues, and modifications (at, symbol) in order; one before the first residue belongs to that."""
    tokens = F.regexp_extract_all(peptide, F.lit(r"(\[[^\]]*\]|[^\[\]])"), 1)
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    # the j-th modification is token i, so i - j residues come before it
    mods = lambda x: F.transform(F.filter(x, lambda y: y["t"].startswith("[")), lambda y, j: _label(F.greatest(y["i"] - j - 1, F.lit(0)), y["t"].substr(F.lit(2), F.length(y["t"]) - 2)))
    return F.struct(F.regexp_replace(peptide, r"\[[^\]]*\]|[\[\]]", "").alias("sequence"), _with(placed, mods).alias("mods"))


def _starts(sequence: Column, text: str) -> Column:
    """Where the text is found, overlaps included."""
    every = F.when(F.length(sequence) >= len(text), F.sequence(F.lit(0), F.length(sequence) - len(text))).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: sequence.substr(i + 1, F.lit(len(text))) == text)


def _places(mods: Column, name: str) -> Column:
    return F.transform(F.filter(mods, lambda m: m["symbol"] == name), lambda m: m["at"])


def _labels(places: Column, symbol: str) -> Column:
    return F.transform(places, lambda at: _label(at, F.lit(symbol)))


def _labelled(parsed: Column, labels: dict, excluding: dict) -> Column:
    """``expected_labels`` as a sorted array of (at, symbol)."""
    sequence, mods = parsed["sequence"], parsed["mods"]
    parts = [F.array().cast("array<struct<at:int,symbol:string>>")]
    for place, symbols in labels.items():
        symbols = [s for s in _listed(symbols) if s]
        if not symbols:
            continue
        starts = F.array(F.lit(0)) if place == "nTerm" else _starts(sequence, place)
        parts += [_labels(starts, s) for s in symbols]
    found = F.concat(*parts)
    if not excluding:
        return F.array_sort(found)
    # each such modification takes away one label of its place
    gone = F.concat(*[_labels(_places(mods, other), s) for other, s in excluding.items()])

    def less(both: Column) -> Column:
        have, take = both["have"], both["take"]
        copies = lambda x, e: F.size(F.filter(x, lambda y: y == e))
        left = F.transform(F.array_intersect(have, take), lambda e: F.array_repeat(e, F.greatest(copies(have, e) - copies(take, e), F.lit(0))))
        return F.array_sort(F.concat(F.filter(have, lambda e: ~F.array_contains(take, e)), F.flatten(left)))

    return _with(F.struct(found.alias("have"), gone.alias("take")), less)


def _state(parsed: Column, expected: Column, setup: LabelSetup) -> Column:
    """``label_state``; ``expected`` holds the labels of each state."""
    if not setup.states:
        return F.lit(-1)
    states = list(setup.states)
    seen = F.array_sort(F.filter(parsed["mods"], lambda m: m["symbol"].isin(*setup.symbols))) if setup.symbols else F.array().cast("array<struct<at:int,symbol:string>>")
    fits = _with(seen, lambda own: F.array_max(F.array(*[F.when(expected[i] == own, F.lit(i)) for i in range(len(states))])))
    found = _with(fits, lambda i: F.when(i.isNull(), -2).when(F.size(F.array_distinct(expected)) < len(states), -3).otherwise(F.element_at(F.array(*[F.lit(s) for s in states]), i + 1)))
    if setup.residues & {"nTerm", "cTerm"}:
        return found
    some = F.lit(False)
    for residue in setup.residues:
        some = some | parsed["sequence"].contains(residue)
    return F.when(some, found).otherwise(-1)


def _by_state(peptide: Column, setup: LabelSetup, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of the expected labels of all states and the state; null for null."""

    def judged(parsed: Column) -> Column:
        expected = F.array(*[_labelled(parsed, *rules) for rules in setup.states.values()]).cast("array<array<struct<at:int,symbol:string>>>")
        return _with(expected, lambda e: f(e, _state(parsed, e, setup)))

    return F.when(peptide.isNotNull(), _with(_parsed(peptide), judged))


def label_state_column(peptide: Column, setup: LabelSetup) -> Column:
    """``label_state`` of each row; null for null."""
    return _by_state(peptide, setup, lambda _, state: state.cast("int"))


def mass_differences_column(peptide: Column, setup: LabelSetup) -> Column:
    """``mass_differences`` of each row; null for null. Labels whose masses are not known are an error."""
    unknown = sorted(setup.symbols - constants.MODIFICATION_MASSES.keys())
    if unknown:
        raise ValueError(f"labels without a mass: {', '.join(unknown)}")
    states = list(setup.states)
    none = F.array().cast("array<struct<state:int,mass:double>>")

    def mass(label: Column) -> Column:
        chosen = F.lit(0.0)
        for symbol in sorted(setup.symbols):
            chosen = F.when(label["symbol"] == symbol, constants.MODIFICATION_MASSES[symbol]).otherwise(chosen)
        return chosen

    def apart(expected: Column, state: Column) -> Column:
        sums = F.transform(expected, lambda own: F.aggregate(own, F.lit(0.0), lambda total, label: total + mass(label)))
        named = F.transform(sums, lambda m, i: F.struct(F.element_at(F.array(*[F.lit(s) for s in states]), i + 1).alias("state"), m.alias("mass"))) if states else none
        own = lambda x, s: F.filter(x, lambda y: y["state"] == s)[0]["mass"]
        others = lambda x, s: F.transform(F.filter(x, lambda y: y["state"] != s), lambda y: F.struct(y["state"].alias("state"), (y["mass"] - own(x, s)).alias("mass")))
        return _with(state, lambda s: F.map_from_entries(F.when(s < 0, none).otherwise(_with(named, lambda x: others(x, s)))))

    return _by_state(peptide, setup, apart)
