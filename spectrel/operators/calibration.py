"""Mass calibration of MS1 spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import DeviationModel

# Masses of common background ions.
LOCK_MASSES = [445.12002, 519.13882, 593.15761, 667.1764, 536.16536, 610.18416, 684.20295]


def calibration_targets(scans: DataFrame, psms: DataFrame | None, lock_masses: list[float] | None = None, scan_range: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """(specfile, id, obsMz, excMz, source): masses to look for in each MS1 scan (specfile, id, rt).

    Lock masses are looked for in every scan; the precursor of a match (obsMz, excMz, precursorId) in its scan and those
    ``scan_range`` away in the order of time. Places before the first and after the last scan are dropped.
    """
    parts = []
    if lock_masses:
        locks = F.explode(F.array(*[F.lit(m) for m in lock_masses])).alias("excMz")
        parts.append(scans.select("specfile", "id", locks).select("specfile", "id", F.col("excMz").alias("obsMz"), "excMz", F.lit("lock").alias("source")))
    if psms is not None:
        placed = scans.select("specfile", "id", F.row_number().over(Window.partitionBy("specfile").orderBy("rt", "id")).alias("pos"))
        own = psms.join(placed.select("specfile", F.col("id").alias("precursorId"), "pos"), ["specfile", "precursorId"])
        apart = own.select("specfile", "obsMz", "excMz", "pos", F.explode(F.array(*[F.lit(i) for i in scan_range])).alias("apart"))
        spread = apart.select("specfile", "obsMz", "excMz", (F.col("pos") + F.col("apart")).alias("pos"))
        parts.append(spread.join(placed, ["specfile", "pos"]).select("specfile", "id", "obsMz", "excMz", F.lit("psm").alias("source")))
    if not parts:
        raise ValueError("neither lock masses nor matches are given")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def calibration_data(targets: DataFrame, ions: DataFrame, tolerance: float = 10e-6, mode: str = "relative", top: int | None = None) -> DataFrame:
    """For each target the nearest ion of its scan within the tolerance of obsMz: obsMz, excMz, relDev, absDev, int.

    ``ions`` holds a scan's arrays (specfile, id, rt, mz, i). With ``top`` only that many of the most intense ions count.
    """
    zipped = F.transform(F.arrays_zip(F.col("mz").alias("m"), F.col("i").alias("v")), lambda x: F.struct(x["v"].alias("v"), x["m"].alias("m")))
    chosen = F.slice(F.reverse(F.array_sort(zipped)), 1, top) if top else zipped
    joined = targets.join(ions.select("specfile", "id", "rt", chosen.alias("ions")), ["specfile", "id"]).withColumnRenamed("obsMz", "wanted")
    reach = F.col("wanted") * tolerance if mode == "relative" else F.lit(tolerance)
    near = F.filter("ions", lambda x: F.abs(x["m"] - F.col("wanted")) <= reach)
    best = F.array_min(F.transform(near, lambda x: F.struct(F.abs(x["m"] - F.col("wanted")).alias("d"), x["m"].alias("m"), x["v"].alias("v"))))
    hit = joined.withColumn("b", best).where("b is not null")
    return hit.select("specfile", "id", "rt", "source", F.col("b.m").alias("obsMz"), "excMz", (1 - F.col("b.m") / F.col("excMz")).alias("relDev"), (F.col("b.m") - F.col("excMz")).alias("absDev"), F.col("b.v").alias("int"))


def weighted_medians(medians: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """For each place the mean of medians within the narrowest window of ``least`` points, its own twice the weight of others; NaN without any."""
    places = np.arange(len(counts))
    some = counts > 0
    running = lambda x: np.concatenate((np.zeros(1, x.dtype), np.cumsum(x)))
    points, filled, total = running(counts), running(some.astype(np.int64)), running(np.where(some, medians, 0.0))

    def within(sums, width):
        return sums[np.minimum(places + width + 1, len(counts))] - sums[np.maximum(places - width, 0)]

    # the least width that holds the points, or else the one that reaches both ends
    low, high = np.zeros(len(counts), np.int64), np.maximum(places, len(counts) - 1 - places)
    while (low < high).any():
        middle = (low + high) // 2
        enough = within(points, middle) >= least
        low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
    weight = within(filled, low) + some
    value = within(total, low) + np.where(some, medians, 0.0)
    return np.where(weight > 0, value / np.maximum(weight, 1), np.nan)


def time_medians(scans: DataFrame, data: DataFrame, least: int = 50, deviation: str = "relDev") -> DataFrame:
    """(specfile, id, rt, correction): for each MS1 scan the mean of medians, its own with weight 1 and its neighbours' with 1/2.

    Neighbours are added on both sides until ``least`` points are reached, or both ends; null where there is no data.
    A run is one group: its scans, not its data points. All windows of a run are found at once: sums over any window are
    differences of running sums, and each scan's least width by bisection. Scans at the same time are ordered by id; null
    deviations are not counted.
    """
    known = data.where(F.col(deviation).isNotNull())
    medians = known.groupBy("specfile", "id").agg(F.percentile(deviation, 0.5).alias("med"), F.count("*").alias("n"))
    rows = scans.select("specfile", "id", "rt").join(medians, ["specfile", "id"], "left")

    def widen(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values(["rt", "id"]).reset_index(drop=True)
        out = weighted_medians(run["med"].to_numpy(float), run["n"].fillna(0).to_numpy(np.int64), least)
        return pd.DataFrame({"specfile": run["specfile"], "id": run["id"], "rt": run["rt"], "correction": out}).replace({np.nan: None})

    return rows.groupBy("specfile").applyInPandas(widen, "specfile string, id string, rt double, correction double")


def apply_time_correction(spectra: DataFrame, corrections: DataFrame, mode: str = "relative") -> DataFrame:
    """mz arrays times (1 + correction), or plus it. Spectra without a correction stay as they are."""
    if mode not in ("relative", "absolute"):
        raise ValueError(f"unknown mode: {mode}")
    c = F.coalesce("correction", F.lit(0.0))
    moved = F.transform("mz", lambda x: x * (1 + c) if mode == "relative" else x + c)
    return spectra.join(corrections.select("specfile", "id", "correction"), ["specfile", "id"], "left").withColumn("mz", moved).drop("correction")


def apply_mass_model(spectra: DataFrame, model: DeviationModel, mode: str = "relative") -> DataFrame:
    """mz arrays of MS1 spectra corrected by a model of the deviation at each m/z."""

    @F.pandas_udf("array<double>")
    def move(arrays: pd.Series) -> pd.Series:
        def one(mz):
            mz = np.asarray(mz, float)
            if not len(mz):
                return mz
            return mz * (1 + model(mz)) if mode == "relative" else mz + model(mz)

        return arrays.map(lambda x: None if x is None else one(x))

    return spectra.withColumn("mz", F.when(F.col("msLevel") == 1, move("mz")).otherwise(F.col("mz")))
