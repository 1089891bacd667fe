"""LC-MS features: featureXML and tab-separated feature lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masses import mh_from_mz

_FEATURE = (
    "_id string, position array<struct<_VALUE:string,_dim:int>>, intensity string, overallquality string, charge int, "
    "convexhull array<struct<_nr:string,pt:array<struct<_x:double,_y:double>>>>, userParam array<struct<_name:string,_value:string,_type:string>>, UserParam array<struct<_name:string,_value:string,_type:string>>"
)


def _finished(rows: DataFrame) -> DataFrame:
    false = F.lit(False)
    return rows.withColumns({"mh": mh_from_mz(F.col("mz"), F.col("charge")), "rtArea": F.col("rtHigh") - F.col("rtLow"), "isValid": F.lit(True), "isMatched": false, "isAnnotated": false})


def read_feature_xml(spark: SparkSession, path: str, specfile: str) -> DataFrame:
    """Features of a featureXML file; the first convex hull bounds their time."""
    schema = _FEATURE.replace(", UserParam array<struct<_name:string,_value:string,_type:string>>", "")
    raw = spark.read.format("xml").option("rowTag", "feature").schema(schema).load(path)
    at = lambda d: F.try_element_at(F.filter("position", lambda p: p["_dim"] == d), F.lit(1))["_VALUE"].cast("double")
    hull = F.coalesce(F.try_element_at(F.filter("convexhull", lambda h: h["_nr"] == "0"), F.lit(1)), F.get("convexhull", F.lit(0)))
    times = F.transform(hull["pt"], lambda p: p["_x"])
    user = lambda name: F.try_element_at(F.filter("userParam", lambda p: p["_name"] == name), F.lit(1))["_value"].cast("double")
    rows = raw.select(
        F.lit(specfile).alias("specfile"), F.col("_id").alias("id"), F.monotonically_increasing_id().alias("ord"), at(0).alias("rt"), at(1).alias("mz"), F.col("intensity").cast("double").alias("intensity"),
        F.col("overallquality").cast("double").alias("quality"), "charge", F.array_min(times).alias("rtLow"), F.array_max(times).alias("rtHigh"), user("FWHM").alias("rtFwhm"),
    )
    return _finished(rows)


def dinosaur_rows(table: DataFrame, specfile: str) -> DataFrame:
    """Features from a feature list's columns (strings) and ord; times are in minutes. The id is the row's number."""
    minutes = lambda name: F.col(name).cast("double") * 60
    rows = table.select(
        F.lit(specfile).alias("specfile"), F.col("ord").cast("string").alias("id"), "ord", minutes("rtApex").alias("rt"), minutes("rtStart").alias("rtLow"), minutes("rtEnd").alias("rtHigh"), minutes("fwhm").alias("rtFwhm"),
        F.col("mz").cast("double").alias("mz"), F.col("charge").cast("double").cast("int").alias("charge"), F.col("intensitySum").cast("double").alias("intensity"), F.col("intensityApex").cast("double").alias("intensityApex"),
        F.col("nScans").cast("double").cast("int").alias("numScans"),
    )
    return _finished(rows)


def read_dinosaur(spark: SparkSession, path: str, specfile: str) -> DataFrame:
    table = spark.read.csv(path, sep="\t", header=True)
    # numbers follow the lines of the file: zipWithIndex counts a partition's rows before numbering
    numbered = table.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    return dinosaur_rows(spark.createDataFrame(numbered, ", ".join(f"`{c}` string" for c in table.columns) + ", ord long"), specfile)


def read_features(spark: SparkSession, path: str, specfile: str) -> DataFrame:
    """By the file's ending: .featurexml or .features.tsv."""
    low = path.lower()
    if low.endswith(".featurexml"):
        return read_feature_xml(spark, path, specfile)
    if low.endswith((".features.tsv", ".feature.tsv")):
        return read_dinosaur(spark, path, specfile)
    raise ValueError(f"unknown feature format: {path}")
