"""Ontologies in OBO format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def terms(stanzas: DataFrame) -> DataFrame:
    """(id, name, isObsolete, attributes) of [Term] stanzas (value, ord). Of a repeated attribute the last counts."""
    body = F.regexp_replace(F.col("value"), r"(?s)\n\s*\[[A-Z][A-Za-z]+\].*$", "")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", ""))), lambda x: x.contains(": "))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.regexp_replace(x, r"^.*?: ", "").alias("v")))
    empty = F.create_map().cast("map<string,string>")
    table = F.aggregate(pairs, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    obsolete = F.coalesce(F.lower(F.try_element_at("attributes", F.lit("is_obsolete"))) == "true", F.lit(False))
    return stanzas.select("ord", table.alias("attributes")).where("map_contains_key(attributes, 'id')").select(F.col("attributes")["id"].alias("id"), F.try_element_at("attributes", F.lit("name")).alias("name"), obsolete.alias("isObsolete"), "attributes", "ord")


def live_terms(read: DataFrame) -> DataFrame:
    """One row for each id: one in use goes before an obsolete one. Two in use are an error."""
    w = Window.partitionBy("id")
    live = F.count(F.when(~F.col("isObsolete"), 1)).over(w)
    ranked = read.withColumns({"_live": live, "_n": F.row_number().over(w.orderBy("isObsolete", F.col("ord").desc()))}).where("_n = 1")
    checked = F.when(F.col("_live") > 1, F.raise_error(F.concat(F.lit("term defined twice: "), F.col("id"))).cast("string")).otherwise(F.col("id"))
    return ranked.withColumn("id", checked).drop("_live", "_n", "ord")


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, lineSep="[Term]").withColumn("ord", F.monotonically_increasing_id())
    found = terms(raw.where(F.col("value").rlike(r"(?m)^\s*id: ")).where(~F.col("value").startswith("format-version")))
    if found.isEmpty():
        raise ValueError(f"no term in {path}")
    return live_terms(found)


def names_of(table: DataFrame, ontology: DataFrame, column: str, into: str) -> DataFrame:
    """Adds the name of the term in a column; unknown ids give null."""
    return table.join(ontology.select(F.col("id").alias(column), F.col("name").alias(into)), column, "left")
