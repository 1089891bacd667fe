"""Protein databases: digestion of all entries, peptides with their proteins, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import digest, standard_sequence
from .tables import stored


def peptides_of(proteins: DataFrame, rule: str = "[KR]", missed: int = 0, remove_start_m: bool = False, least: int = 6, most: int = 40, ignore_isoleucine: bool = False) -> DataFrame:
    """(peptide, proteinId, startPos, endPos, missedCleavage): edges of the digest; a peptide's first place in a protein counts.

    With ``ignore_isoleucine`` I is read as L; ``peptide`` is that spelling and ``spelling`` the protein's own.
    """
    each = proteins.select(F.col("id").alias("proteinId"), F.explode(digest(F.col("sequence"), rule, missed, remove_start_m, least, most)).alias("p"))
    named = each.select("proteinId", standard_sequence(F.col("p.sequence"), ignore_isoleucine).alias("peptide"), F.col("p.sequence").alias("spelling"), "p.startPos", "p.endPos", "p.missedCleavage", "p.ord")
    first = F.min(F.struct("ord", "startPos", "endPos", "missedCleavage", "spelling")).alias("f")
    return named.groupBy("proteinId", "peptide").agg(first).select("peptide", "proteinId", "f.startPos", "f.endPos", "f.missedCleavage", "f.spelling")


def peptide_table(edges: DataFrame) -> DataFrame:
    """(peptide, missedCleavage, proteins, isUnique)."""
    return edges.groupBy("peptide").agg(F.min("missedCleavage").alias("missedCleavage"), F.countDistinct("proteinId").alias("proteins")).withColumn("isUnique", F.col("proteins") == 1)


def mark_unique(edges: DataFrame) -> DataFrame:
    return edges.join(peptide_table(edges).select("peptide", "isUnique"), "peptide")


def protein_table(proteins: DataFrame, edges: DataFrame) -> DataFrame:
    """Proteins with isUnique: whether one of their peptides is theirs alone."""
    own = mark_unique(edges).groupBy("proteinId").agg(F.bool_or("isUnique").alias("_u"))
    return proteins.join(own, F.col("id") == F.col("proteinId"), "left").withColumn("isUnique", F.coalesce("_u", F.lit(False))).drop("_u", "proteinId")


def coverage(proteins: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, length, coveredUnique, coveredShared): residues within unique peptides, and within shared ones (the two may overlap)."""
    spans = mark_unique(stored(edges.select("peptide", "proteinId", "startPos", "endPos", "missedCleavage"), "edges")).select("proteinId", "isUnique", "startPos", "endPos")
    # what a span adds to those before it
    before = Window.partitionBy("proteinId", "isUnique").orderBy("startPos", "endPos").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.withColumn("n", F.greatest(F.lit(0), F.col("endPos") - F.greatest(F.col("startPos") - 1, F.coalesce(F.max("endPos").over(before), F.lit(0)))))
    n = lambda flag: F.sum(F.when(F.col("isUnique") == flag, F.col("n")).otherwise(0))
    counts = fresh.groupBy("proteinId").agg(n(True).alias("u"), n(False).alias("s"))
    joined = proteins.join(counts, F.col("id") == F.col("proteinId"), "left")
    return joined.select("id", F.length("sequence").cast("long").alias("length"), F.coalesce("u", F.lit(0)).cast("long").alias("coveredUnique"), F.coalesce("s", F.lit(0)).cast("long").alias("coveredShared"))


def coverage_mask(proteins: DataFrame, edges: DataFrame, unique: bool = True) -> DataFrame:
    """(id, mask): for each residue whether a unique (or a shared) peptide covers it."""
    spans = mark_unique(edges).where(F.col("isUnique") == unique).groupBy("proteinId").agg(F.collect_set(F.struct("startPos", "endPos")).alias("spans"))
    joined = proteins.where(F.length("sequence") > 0).join(spans, F.col("id") == F.col("proteinId"), "left")
    inside = lambda i: F.exists(F.coalesce("spans", F.array().cast("array<struct<startPos:int,endPos:int>>")), lambda s: i.between(s["startPos"], s["endPos"]))
    return joined.select("id", F.transform(F.sequence(F.lit(1), F.length("sequence")), inside).alias("mask"))


def map_peptides(peptides: DataFrame, edges: DataFrame, members: DataFrame, ignore_unmapped: bool = True) -> DataFrame:
    """For each observed peptide its protein groups' leading proteins, joined by ';' (sorted), and their number of groups."""
    leading = members.where("role = 'leading'").groupBy("group").agg(F.concat_ws(";", F.array_sort(F.collect_set("protein"))).alias("leaders"))
    groups = edges.select("peptide", F.col("proteinId").alias("protein")).join(members.select("group", "protein"), "protein").select("peptide", "group").distinct().join(leading, "group")
    found = groups.groupBy("peptide").agg(F.array_sort(F.collect_set("leaders")).alias("groups"))
    out = peptides.select("peptide").distinct().join(found, "peptide", "inner" if ignore_unmapped else "left")
    return out.select("peptide", F.array_join("groups", " | ").alias("leaders"), F.coalesce(F.size("groups"), F.lit(0)).alias("n_groups"))


def digest_settings(peptides: DataFrame) -> DataFrame:
    """One row: missed cleavages, least and greatest length that digest settings need to give all these peptides."""
    sites = F.length(F.regexp_replace("peptide", "[^KR]", ""))
    return peptides.agg(F.greatest(F.max(sites) - 1, F.lit(0)).alias("missed"), F.min(F.length("peptide")).alias("least"), F.max(F.length("peptide")).alias("most"))
