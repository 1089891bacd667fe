"""Peptide-spectrum matches: ranking, quality control, attributes of their spectra, calculated masses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masses


@dataclass(frozen=True)
class QualityRule:
    """How matches of a run are ranked, and which of them are valid."""

    qc: str = "qValue"
    qc_larger_better: bool = False
    cutoff: float = 0.01
    rank: str = "score"
    rank_larger_better: bool = True


PERCOLATOR = QualityRule()
MSGF = QualityRule(qc="eValue")


def rank_psms(psms: DataFrame, rule: QualityRule = PERCOLATOR, keys: list[str] | None = None, into: str = "rank") -> DataFrame:
    """Rank of each match in its spectrum: equal values share a rank, and the next rank counts them all."""
    by = F.col(rule.rank).desc() if rule.rank_larger_better else F.col(rule.rank).asc()
    return psms.withColumn(into, F.rank().over(Window.partitionBy(*(keys or ["specfile", "id"])).orderBy(by)))


def validate_psms(psms: DataFrame, rule: QualityRule = PERCOLATOR, keys: list[str] | None = None, order: list[str] | None = None, qc_order: str = "source") -> DataFrame:
    """isValid: the first listed match of a spectrum, if it has rank 1 and passes the cutoff.

    ``qc_order='rank'`` looks at the best match instead of the first listed.
    """
    w = Window.partitionBy(*(keys or ["specfile", "id"])).orderBy(*(["rank"] if qc_order == "rank" else []), *(order or ["ord"]))
    passes = F.col(rule.qc) >= rule.cutoff if rule.qc_larger_better else F.col(rule.qc) <= rule.cutoff
    return psms.withColumn("isValid", F.coalesce((F.row_number().over(w) == 1) & (F.col("rank") == 1) & passes, F.lit(False)))


def add_spectrum_info(psms: DataFrame, spectra: DataFrame, columns: tuple[str, ...] = ("obsMz", "rt", "charge"), keys: tuple[str, ...] = ("specfile", "id")) -> DataFrame:
    """Columns of each match's spectrum, in place of its own of that name; null where the spectrum is missing."""
    return psms.drop(*columns).join(spectra.select(*keys, *columns), list(keys), "left")


def add_calculated_mz(psms: DataFrame, guess_charge: bool = True, observed: str = "obsMz") -> DataFrame:
    """excMz of valid matches from the peptide's mass. Each peptide's mass is worked out once; dipeptides (two with a comma) add up."""
    one = psms.where("isValid and peptide is not null").select("peptide").distinct()
    parts = F.split(F.col("peptide"), ",")
    weighed = one.withColumn("_mass", F.aggregate(F.transform(parts, lambda p: masses.peptide_mass(p)), F.lit(0.0), lambda a, x: a + x))
    joined = psms.join(weighed, "peptide", "left")
    charge = F.coalesce(F.col("charge"), masses.guessed_charge(F.col("_mass"), F.col(observed))) if guess_charge else F.col("charge")
    filled = joined.withColumn("charge", F.when(F.col("isValid"), charge).otherwise(F.col("charge")))
    return filled.withColumn("excMz", F.when(F.col("isValid"), masses.mz_from_mass(F.col("_mass"), F.col("charge")))).drop("_mass")
