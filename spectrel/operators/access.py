"""Scans, projections and look-ups on tables of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan(table: DataFrame, runs: list[str] | None = None, where: Column | str | None = None, sort: str | None = None, reverse: bool = False, order: list[str] | None = None) -> DataFrame:
    """Rows of some runs that fulfil a condition, by a column: rows without it are left out, and ties keep their order, also in reverse."""
    out = table if runs is None else table.where(F.col("specfile").isin(runs))
    out = out if where is None else out.where(where)
    if sort is None:
        return out
    by = F.col(sort).desc() if reverse else F.col(sort).asc()
    return out.where(F.col(sort).isNotNull()).orderBy(by, *(order if order is not None else ["ord"]))


def valid(table: DataFrame) -> DataFrame:
    return table.where("isValid")


def project(table: DataFrame, columns: list[str], default=None, keys: tuple[str, ...] = ("id", "specfile")) -> DataFrame:
    """Columns with a default for missing values; columns that the table lacks are all default."""
    def one(name: str) -> Column:
        if name not in table.columns:
            return F.lit(default).alias(name)
        return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default)).alias(name)

    names = [k for k in keys if k in table.columns and k not in columns]
    return table.select(*names, *[one(c) for c in columns])


def item(table: DataFrame, specfile: str, identifier: str) -> DataFrame:
    return table.where((F.col("specfile") == specfile) & (F.col("id") == identifier))


def first_valid(table: DataFrame, specfile: str, identifier: str) -> DataFrame:
    """The first valid row of a spectrum in source order, if any."""
    return item(table, specfile, identifier).where("isValid").orderBy("ord").limit(1)


def by_id_or_name(proteins: DataFrame, key: str) -> DataFrame:
    """The protein of this id, else of this name."""
    hit = proteins.where((F.col("id") == key) | (F.col("name") == key))
    return hit.orderBy((F.col("id") == key).desc(), "id").limit(1)


def remove_runs(table: DataFrame, runs: list[str]) -> DataFrame:
    return table.where(~F.col("specfile").isin(runs))


def add_runs(main: DataFrame, other: DataFrame, key: str = "specfile") -> DataFrame:
    """``main`` and those runs of ``other`` that it lacks."""
    return main.unionByName(other.join(main.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def remove_annotation(features: DataFrame, runs: list[str] | None = None) -> DataFrame:
    """Match and annotation columns as if the features were never matched."""
    ours = F.lit(True) if runs is None else F.col("specfile").isin(runs)
    empty = {"isMatched": False, "isAnnotated": False, "siIds": None, "siiIds": None, "peptide": None, "sequence": None, "score": None}
    return features.withColumns({c: F.when(ours, F.lit(v).cast(features.schema[c].dataType)).otherwise(F.col(c)) for c, v in empty.items() if c in features.columns})


def box_filter(table: DataFrame, first: str, limits: tuple, second: str, other_limits: tuple) -> DataFrame:
    """Rows in a closed rectangle of two columns."""
    return table.where(F.col(first).between(*limits) & F.col(second).between(*other_limits))
