"""Peptide strings and in-silico digestion."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants
from .masses import strip_modifications


def modification_positions(peptide: Column, start: int = 1, strip: str = "UNIMOD:") -> Column:
    """map<modification, positions> of a peptide in bracket notation. One before the first residue counts as the first."""
    parts = F.regexp_extract_all(peptide, F.lit(r"\[[^\]]*\]|[^\[\]]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<name:string,pos:int>>").alias("found"))

    def step(acc: Column, token: Column) -> Column:
        is_mod = token.startswith("[")
        name = F.regexp_replace(token, r"^\[|\]$", "")
        name = F.replace(name, F.lit(strip), F.lit("")) if strip else name
        entry = F.struct(name.alias("name"), (F.greatest(acc["at"] - 1, F.lit(0)) + start).alias("pos"))
        return F.struct(F.when(is_mod, acc["at"]).otherwise(acc["at"] + 1).alias("at"), F.when(is_mod, F.array_append(acc["found"], entry)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(parts, zero, step, lambda acc: acc["found"])
    names = F.array_distinct(F.transform(found, lambda x: x["name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.transform(F.filter(found, lambda x: x["name"] == n), lambda x: x["pos"]).alias("value"))))


def all_substrings(text: Column, part: Column) -> Column:
    """Offsets from 0 of all occurrences, overlapping ones too; none for an empty part."""
    last = F.length(text) - F.length(part)
    places = F.when((last >= 0) & (F.length(part) > 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substring(text, i + 1, F.length(part)) == part)


def digest(sequence: Column, rule: str = "[KR]", missed: int = 0, remove_start_m: bool = True, least: int = 5, most: int = 55) -> Column:
    """array<struct<sequence, startPos, endPos, missedCleavage, ord>> of an in-silico digestion; positions from 1.

    ``rule`` is a regular expression or the name of an enzyme. The order is: peptides after removal of the first M, those
    of the protein's start, then the others; ``ord`` numbers it. Null and empty sequences give none.
    """
    pattern = constants.CLEAVAGE_RULES.get(rule, rule)

    @F.arrow_udf("array<struct<sequence:string,startPos:int,endPos:int,missedCleavage:int,ord:int>>")
    def cut(proteins: pa.Array) -> pa.Array:
        return digested(proteins, pattern, missed, remove_start_m, least, most)

    return cut(sequence)


def _cuts(proteins: list[str], pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ends of matches within each protein, and each one's own end: protein numbers and positions, ascending."""
    lengths = np.fromiter(map(len, proteins), np.int64, len(proteins))
    plain = re.fullmatch(r"\[([A-Za-z]+)\]|([A-Za-z])", pattern)
    if plain and all(map(str.isascii, proteins)):
        # a set of letters: look them up over all proteins together
        wanted = np.zeros(256, bool)
        wanted[list((plain[1] or plain[2]).encode())] = True
        at = np.flatnonzero(wanted[np.frombuffer("".join(proteins).encode(), np.uint8)]) + 1
        stops = np.cumsum(lengths)
        owner = np.searchsorted(stops, at)
        at = at - (stops - lengths)[owner]
    else:
        find = re.compile(pattern).finditer
        each = [np.fromiter((m.end() for m in find(p)), np.int64) for p in proteins]
        owner, at = np.repeat(np.arange(len(proteins)), [len(x) for x in each]), np.concatenate([*each, np.zeros(0, np.int64)])
    real = np.flatnonzero(lengths)
    owner, at = np.concatenate((owner, real)), np.concatenate((at, lengths[real]))
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    new = (at > 0) & np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1]))[: len(at)]
    return owner[new], at[new]


def _slices(proteins: list[str], owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """proteins[owner][start:stop] for each."""
    if not all(map(str.isascii, proteins)):
        return pa.array([proteins[i][a:b] for i, a, b in zip(owner.tolist(), start.tolist(), stop.tolist())], pa.string())
    lengths = np.fromiter(map(len, proteins), np.int64, len(proteins))
    begins = (np.cumsum(lengths) - lengths)[owner] + start
    sizes = stop - start
    ends = np.cumsum(sizes)
    flat = np.frombuffer("".join(proteins).encode(), np.uint8)[np.repeat(begins - (ends - sizes), sizes) + np.arange(sizes.sum())]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(flat)]).cast(pa.string())


def digested(proteins: pa.Array, pattern: str, missed: int, remove_start_m: bool, least: int, most: int) -> pa.Array:
    """The digests of a batch: spans between cuts of all proteins at once, as arrays of numbers."""
    texts = [p or "" for p in proteins.to_pylist()]
    owner, stop = _cuts(texts, pattern)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    place = np.arange(len(owner)) - first[owner]
    start = np.where(place > 0, np.append(0, stop[:-1])[: len(stop)], 0)
    spans = []  # owner, whether after the first M's removal (0) or not (1), number of the start, missed, start, stop
    for m in range(missed + 1):
        i = np.flatnonzero(place + m < (first[1:] - first[:-1])[owner]) if len(owner) else owner
        spans.append((owner[i], np.ones(len(i), np.int64), place[i], np.full(len(i), m), start[i], stop[i + m]))
        if remove_start_m:
            i = i[place[i] == 0]
            i = i[[texts[k][0] == "M" for k in owner[i].tolist()]] if len(i) else i
            spans.append((owner[i], np.zeros(len(i), np.int64), place[i], np.full(len(i), m), start[i] + 1, stop[i + m]))
    owner, kind, number, lost, start, stop = (np.concatenate(x) for x in zip(*spans))
    size = stop - start
    keep = np.flatnonzero((size >= least) & (size <= most))
    keep = keep[np.lexsort((lost[keep], number[keep], kind[keep], owner[keep]))]
    owner, lost, start, stop = owner[keep], lost[keep], start[keep], stop[keep]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    ints = [pa.array(x.astype(np.int32)) for x in (start + 1, stop, lost, np.arange(len(owner)) - bounds[owner])]
    made = pa.StructArray.from_arrays([_slices(texts, owner, start, stop), *ints], ["sequence", "startPos", "endPos", "missedCleavage", "ord"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), made)


def standard_sequence(sequence: Column, ignore_isoleucine: bool) -> Column:
    return F.translate(sequence, "I", "L") if ignore_isoleucine else sequence


__all__ = ["all_substrings", "digest", "digested", "modification_positions", "standard_sequence", "strip_modifications"]
