"""Peptide identifications: Percolator tables and mzIdentML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import UNIMOD_TITLES
from ..functions.masses import strip_modifications
from ..operators.psm import MSGF, PERCOLATOR, QualityRule, rank_psms, validate_psms


def percolator_rows(lines: DataFrame, specfile: str, engine: str) -> DataFrame:
    """PSMs from the text lines (value, ord) of a Percolator table. Columns are found by the header; proteins after the last one
    may hold further tabs. ``engine``: comet, msgf or xtandem, which name scans differently."""
    place = {"comet": -3, "msgf": -3, "xtandem": -2}
    if engine not in place:
        raise ValueError(f"unknown engine: {engine}")
    parts = lines.withColumn("p", F.split("value", "\t"))
    header = parts.where(F.col("value").startswith("PSMId\t")).orderBy("ord").select("p").first()
    if header is None:
        raise ValueError("no header line")
    names = header["p"]
    column = lambda name: F.get("p", F.lit(names.index(name)))
    # between the first and the last dot, where there is one
    bare = F.when(column("peptide").contains("."), F.get(F.split(column("peptide"), r"\."), F.lit(1))).otherwise(column("peptide"))
    peptide = F.replace(bare, F.lit("[UNIMOD:"), F.lit("[u:"))
    rows = parts.where(~F.col("value").startswith("PSMId\t") & (F.col("value") != "")).select(
        F.lit(specfile).alias("specfile"), F.element_at(F.split(column("PSMId"), "_"), place[engine]).alias("id"), "ord", peptide.alias("peptide"),
        column("score").cast("double").alias("score"), column("q-value").cast("double").alias("qValue"), column("posterior_error_prob").cast("double").alias("pep"),
    )
    return rows.withColumn("sequence", strip_modifications(F.col("peptide")))


def read_percolator(spark: SparkSession, path: str, specfile: str, engine: str, rule: QualityRule = PERCOLATOR) -> DataFrame:
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return validate_psms(rank_psms(percolator_rows(lines, specfile, engine), rule), rule)


_CV = "array<struct<_accession:string,_name:string,_value:string>>"
_RESULT = f"_spectrumID string, SpectrumIdentificationItem array<struct<_id:string,_chargeState:int,_rank:int,_passThreshold:string,_peptide_ref:string,_experimentalMassToCharge:double,cvParam:{_CV}>>, cvParam {_CV}"
_PEPTIDE = f"_id string, PeptideSequence string, Modification array<struct<_location:int,cvParam:{_CV}>>"


def with_modifications(sequence: Column, modifications: Column) -> Column:
    """A sequence with its modifications (struct<at, name>) in brackets behind their residues; place 0 is before the first."""
    letters = F.filter(F.split(sequence, ""), lambda x: x != "")
    mark = lambda at: F.concat_ws("", F.transform(F.filter(modifications, lambda m: m["at"] == at), lambda m: F.concat(F.lit("["), m["name"], F.lit("]"))))
    return F.concat(mark(F.lit(0)), F.concat_ws("", F.transform(letters, lambda x, i: F.concat(x, mark(i + 1)))))


def read_mzid(spark: SparkSession, path: str, specfile: str | None = None, rule: QualityRule = MSGF) -> DataFrame:
    """PSMs of an mzIdentML file: the first item of each spectrum; score is -log10 of the E-value."""
    titles = F.create_map(*[F.lit(x) for k, v in UNIMOD_TITLES.items() for x in (k, f"u:{v}")])
    results = spark.read.format("xml").option("rowTag", "SpectrumIdentificationResult").schema(_RESULT).load(path).withColumn("ord", F.monotonically_increasing_id())
    peptides = spark.read.format("xml").option("rowTag", "Peptide").schema(_PEPTIDE).load(path)
    mods = F.transform(F.coalesce("Modification", F.array()), lambda m: F.struct(m["_location"].alias("at"), F.coalesce(F.try_element_at(titles, F.get(m["cvParam"], F.lit(0))["_name"]), F.get(m["cvParam"], F.lit(0))["_name"]).alias("name")))
    forms = peptides.select(F.col("_id").alias("ref"), F.col("PeptideSequence").alias("sequence"), with_modifications(F.col("PeptideSequence"), mods).alias("peptide"))
    value = lambda column, name: F.try_element_at(F.filter(column, lambda p: p["_name"] == name), F.lit(1))["_value"]
    item = F.get("SpectrumIdentificationItem", F.lit(0))
    run = F.lit(specfile) if specfile else F.regexp_replace(F.regexp_extract("_metadata.file_name", r"([^/]+)$", 1), r"\.mzid(\.gz)?$", "")
    number = F.coalesce(value(F.col("cvParam"), "scan number(s)"), F.regexp_extract("_spectrumID", r"scan=(\S+)", 1))
    rows = results.select(
        run.alias("specfile"), number.alias("id"), "ord", item["_peptide_ref"].alias("ref"), item["_chargeState"].alias("charge"),
        value(item["cvParam"], "MS-GF:EValue").cast("double").alias("eValue"), value(item["cvParam"], "MS-GF:SpecEValue").cast("double").alias("specEValue"),
    )
    found = rows.join(forms, "ref").drop("ref").withColumn("score", -F.log10("eValue"))
    return validate_psms(rank_psms(found, rule), rule)
