"""Mass arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants


def _lookup(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])


def mh_from_mz(mz: Column, charge: Column) -> Column:
    return mz * charge - constants.PROTON * (charge - 1)


def mz_from_mh(mh: Column, charge: Column) -> Column:
    return (mh + constants.PROTON * (charge - 1)) / charge


def mz_from_mass(mass: Column, charge: Column) -> Column:
    return (mass + constants.PROTON * charge) / charge


def mass_from_mz(mz: Column, charge: Column) -> Column:
    return (mz - constants.PROTON) * charge


def strip_modifications(peptide: Column) -> Column:
    return F.regexp_replace(peptide, r"\[[^\]]*\]", "")


def peptide_mass(peptide: Column, residues: dict[str, float] | None = None, modifications: dict[str, float] | None = None) -> Column:
    """Monoisotopic mass of a peptide in bracket notation; unknown residues and modifications raise an error."""
    residue, modification = _lookup(residues or constants.RESIDUE_MASSES), _lookup(modifications or constants.MODIFICATION_MASSES)

    def known(table: Column, what: str):
        return lambda total, x: total + F.coalesce(F.try_element_at(table, x), F.raise_error(F.concat(F.lit(f"unknown {what}: "), x)).cast("double"))

    letters = F.filter(F.split(strip_modifications(peptide), ""), lambda x: x != "")
    mods = F.regexp_extract_all(peptide, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    return F.aggregate(letters, F.lit(0.0), known(residue, "residue")) + F.aggregate(mods, F.lit(0.0), known(modification, "modification")) + F.lit(constants.WATER)


def guessed_charge(mass: Column, mz: Column) -> Column:
    return F.bround(mass / (mz - constants.PROTON)).cast("int")


def relative_mass_to_log2(limit: Column) -> Column:
    return F.log2(1 + limit)


def overlaps(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    return (a_min <= b_max) & (b_min <= a_max)


def deviation_limits(values: Column, tolerance: float, mode: str) -> tuple[Column, Column]:
    """Lower and upper limit around an array's range; ``mode``: relative or absolute."""
    low, high = F.array_min(values), F.array_max(values)
    if mode == "relative":
        return low * (1 - tolerance), high * (1 + tolerance)
    if mode == "absolute":
        return low - tolerance, high + tolerance
    raise ValueError(f"unknown mode: {mode}")


def log10_factorial(n: Column) -> Column:
    """log10(n!) as a sum of logarithms: no overflow, for any n."""
    return F.when(n < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda t, i: t + F.log10(i)))
