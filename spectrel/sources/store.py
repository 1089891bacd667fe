"""Tables of runs as Parquet, partitioned by run: a run is read, replaced or dropped without touching the others. Whole tables are versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_TABLES = ("runs", "chromatograms", "metadata", "arrays", "spectra")


def save(table: DataFrame, root: str, name: str) -> None:
    """Write a table's runs; those already there are replaced, others stay."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("specfile").parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str, name: str, runs: list[str] | None = None) -> DataFrame:
    """A table, of some runs only if given: other runs' files are never opened."""
    table = spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")
    return table if runs is None else table.where(F.col("specfile").isin(runs))


def save_run(tables: dict[str, DataFrame], root: str, names: tuple[str, ...] = RUN_TABLES) -> None:
    for name in names:
        if name in tables:
            save(tables[name], root, name)


def load_run(spark: SparkSession, root: str, names: tuple[str, ...] = RUN_TABLES, runs: list[str] | None = None) -> dict[str, DataFrame]:
    return {name: load(spark, root, name, runs) for name in names}


#: The file that names the version of a whole table that holds.
CURRENT = "CURRENT"


def _files(spark: SparkSession, path: str):
    """The JVM, Hadoop's path, and the file context of its file system, whose renames replace the target in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf)


def _version(spark: SparkSession, folder: str) -> str | None:
    rows = spark.read.text(f"{folder}/{CURRENT}").collect() if _exists(spark, f"{folder}/{CURRENT}") else []
    return rows[0]["value"] if rows else None


def _exists(spark: SparkSession, path: str) -> bool:
    _, at, files = _files(spark, path)
    return files.util().exists(at)


def save_whole(table: DataFrame, root: str, name: str, keep: int = 2) -> str:
    """Write a table that has no runs (groups, proteins, peptides) as a new version, and name it the current one last.

    A reader sees the version before or the new one, never a part; a table may be written over its own earlier version. The
    ``keep`` latest versions stay for readers that are still at work; a job that fails leaves the current one in place.
    """
    spark, folder = table.sparkSession, f"{root}/{name}"
    before = _version(spark, folder)
    number = int(before.split("-")[1]) + 1 if before else 0
    version = f"v-{number:06}-{uuid.uuid4().hex}"
    table.write.parquet(f"{folder}/{version}")
    jvm, at, files = _files(spark, folder)
    path = lambda x: jvm.org.apache.hadoop.fs.Path(at, x)
    _write_line(spark, f"{folder}/{CURRENT}.{version}", version)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(path(f"{CURRENT}.{version}"), path(CURRENT), options)
    versions = sorted(x.getPath().getName() for x in files.util().listStatus(at) if x.getPath().getName().startswith("v-") and x.getPath().getName() <= version)
    for old in versions[:-keep]:
        files.delete(path(old), True)
    return version


def _write_line(spark: SparkSession, path: str, line: str) -> None:
    jvm, at, _ = _files(spark, path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    stream.write(bytearray((line + "\n").encode()))
    stream.close()


def load_whole(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version of a table written by ``save_whole``."""
    version = _version(spark, f"{root}/{name}")
    if version is None:
        raise FileNotFoundError(f"{root}/{name} has no version")
    return spark.read.parquet(f"{root}/{name}/{version}")
