"""FASTA files. Records are split by Spark's text source, so large files are read in parallel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta_records(lines: DataFrame) -> DataFrame:
    """(header, sequence) of records (value: a header line and its sequence lines). White space and a final * are dropped,
    and so are text before the first header, and headers without a sequence."""
    body = F.regexp_replace(F.col("value"), "^>", "")
    parts = lines.select(F.regexp_extract(body, r"^([^\r\n]*)", 1).alias("header"), F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"\s", "").alias("sequence"))
    return parts.select(F.trim("header").alias("header"), F.regexp_replace("sequence", r"\*$", "").alias("sequence")).where("sequence <> ''")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of a FASTA file; one without any header is an error."""
    raw = spark.read.text(path, lineSep="\n>")
    if raw.where(F.col("value").startswith(">")).isEmpty():
        raise ValueError(f"no FASTA header at the start of {path}")
    return fasta_records(raw)


def uniprot_header(header: Column) -> Column:
    """map with db, id, entry, name, gene_id, taxon and the KEY=value fields of a UniProt header; null if it is none."""
    part = lambda i: F.regexp_extract(header, r"^(sp|tr|up|ur)\|([^|]*)\|((\S*?)(?:_(\S+))?)(?:\s+(.*?))?(?=\s+[A-Z]{2}=|$)", i)
    field = lambda key: F.regexp_extract(header, rf"\b{key}=(.*?)(?=\s+[A-Z]{{2}}=|$)", 1)
    pairs = {"db": part(1), "id": part(2), "entry": part(3), "gene_id": part(4), "taxon": part(5), "name": F.concat_ws(" ", part(3), F.nullif(part(6), F.lit("")))}
    pairs |= {k: field(k) for k in ("OS", "OX", "GN", "PE", "SV")}
    table = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return F.when(part(2) != "", F.map_filter(table, lambda k, v: v != ""))


def sgd_header(header: Column) -> Column:
    part = lambda i: F.regexp_extract(header, r"(\S+)\s(\S+).+(\".+\")", i)
    return F.when(part(1) != "", F.create_map(F.lit("id"), part(1), F.lit("name"), part(2), F.lit("description"), part(3)))


def accession_header(header: Column) -> Column:
    """map with id: between the bars of a database header, else up to the first space or bar."""
    barred = F.substring(header, 1, 3).isin("sp|", "tr|", "up|")
    return F.create_map(F.lit("id"), F.when(barred, F.regexp_extract(header, r"^...([^|]*)", 1)).otherwise(F.regexp_extract(header, r"^([^\s|]*)", 1)))


def proteins(records: DataFrame, parser: Callable[[Column], Column] = uniprot_header, force_id: bool = False, decoy: str = "[decoy]", contaminant: str = "[cont]") -> DataFrame:
    """Table of proteins. Tags in front of a header mark decoys (their tag stays part of the id) and contaminants.

    A header that the parser can't read is an error, or with ``force_id`` its own id. Of repeated ids one entry stays.
    """
    header = F.col("header")
    bare = F.replace(F.replace(header, F.lit(decoy), F.lit("")), F.lit(contaminant), F.lit(""))
    info = parser(bare)
    whole = F.create_map(F.lit("id"), bare)
    read = F.coalesce(info, whole if force_id else F.raise_error(F.concat(F.lit("unreadable FASTA header: "), header)).cast("map<string,string>"))
    tagged = records.select("header", "sequence", header.contains(decoy).alias("isDecoy"), header.contains(contaminant).alias("isContaminant"), read.alias("headerInfo"))
    mark = F.when(F.col("isDecoy"), F.lit(decoy)).otherwise(F.lit(""))
    name = F.coalesce(F.try_element_at("headerInfo", F.lit("name")), F.try_element_at("headerInfo", F.lit("id")))
    out = tagged.select(F.concat(mark, F.col("headerInfo")["id"]).alias("id"), F.concat(mark, name).alias("name"), "sequence", F.col("header").alias("fastaHeader"), "headerInfo", "isDecoy", "isContaminant")
    return out.groupBy("id").agg(F.max(F.struct("fastaHeader", "name", "sequence", "isDecoy", "isContaminant")).alias("r"), F.max_by("headerInfo", F.struct("fastaHeader", "name", "sequence")).alias("headerInfo")).select("id", "r.name", "r.sequence", "r.fastaHeader", "headerInfo", "r.isDecoy", "r.isContaminant")
