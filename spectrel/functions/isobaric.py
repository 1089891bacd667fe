"""Isobaric labels: reporter ions and correction of isotope impurities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numerics import nnls, nnls_rows


def normalized(matrix: list[list[float]]) -> list[list[float]]:
    """Each row sums to one; rows of zeros stay."""
    return [[x / sum(row) for x in row] if sum(row) else list(row) for row in matrix]


def padded(matrix: list[list[float]], before: int, after: int, stride: int = 1) -> list[list[float]]:
    """Rows of shifts -before .. +after become rows of channels; a shift leads ``stride`` channels on."""
    n = len(matrix)
    out = [[0.0] * n for _ in range(n)]
    for i, row in enumerate(matrix):
        for j, x in enumerate(row[: before + 1 + after]):
            at = i + stride * (j - before)
            if 0 <= at < n:
                out[i][at] = x
    return out


@dataclass(frozen=True)
class IsobaricTag:
    reagent: str
    reporters: tuple[float, ...]
    labels: tuple[str, ...]
    impurities: tuple[tuple[float, ...], ...] | None = None
    before: int = 2
    after: int = 2
    #: Channels between neighbours of one series: 2 where series with a heavy carbon and with a heavy nitrogen alternate.
    stride: int = 1

    @property
    def matrix(self) -> np.ndarray:
        """Channels as columns: what a label's ions give in each channel."""
        if self.impurities is None:
            raise ValueError(f"{self.reagent} needs an impurity matrix")
        return np.array(padded(normalized([list(r) for r in self.impurities]), self.before, self.after, self.stride)).T

    def corrected(self, intensities) -> np.ndarray:
        return nnls(self.matrix, np.asarray(intensities, float))


# Reporter masses, label names and isotope impurities of the reagents.
ITRAQ4 = IsobaricTag(
    "iTRAQ4plex", (114.1112, 115.1083, 116.1116, 117.1150), ("114", "115", "116", "117"),
    ((0.00, 1.00, 92.90, 5.90, 0.20), (0.00, 2.00, 92.30, 5.60, 0.10), (0.00, 3.00, 92.40, 4.50, 0.10), (0.10, 4.00, 92.30, 3.50, 0.10)),
)
ITRAQ8 = IsobaricTag(
    "iTRAQ8plex", (113.10787, 114.11123, 115.10826, 116.11162, 117.11497, 118.11201, 119.11530, 120.08077, 121.12200), ("113", "114", "115", "116", "117", "118", "119", "fImmonium", "121"),
    (
        (0.00, 0.00, 92.87, 6.89, 0.24), (0.00, 0.94, 93.00, 5.90, 0.16), (0.00, 1.88, 93.12, 4.90, 0.10), (0.00, 2.82, 93.21, 3.90, 0.07), (0.06, 3.77, 93.29, 2.88, 0.00), (0.09, 4.71, 93.29, 1.91, 0.00),
        (0.14, 5.66, 93.33, 0.87, 0.00), (0.00, 0.00, 91.86, 8.14, 0.00), (0.27, 7.44, 92.11, 0.18, 0.00),
    ),
)
TMT_REPORTERS = {
    ("TMT2plex", "hcd"): (126.127726, 127.131081),
    ("TMT2plex", "etd"): (114.127725, 114.127725),
    ("TMT6plex", "hcd"): (126.127726, 127.124761, 128.134436, 129.131471, 130.141145, 131.138180),
    ("TMT6plex", "etd"): (114.127725, 115.124760, 116.134433, 117.131468, 118.141141, 119.138176),
    ("TMT10plex", "hcd"): (126.127725, 127.124760, 127.131079, 128.128114, 128.134433, 129.131468, 129.137787, 130.134822, 130.141141, 131.138176),
    ("TMT10plex", "etd"): (114.127725, 115.124760, 114.127725, 115.124760, 116.134433, 117.131468, 116.134433, 117.131468, 118.141141, 119.138176),
}
TMT_LABELS = {
    "TMT2plex": ("126", "127C"),
    "TMT6plex": ("126", "127N", "128C", "129N", "130C", "131"),
    "TMT10plex": ("126", "127N", "127C", "128N", "128C", "129N", "129C", "130N", "130C", "131"),
}


def tmt(reagent: str, fragmentation: str = "hcd", impurities: tuple[tuple[float, ...], ...] | None = None) -> IsobaricTag:
    """A TMT reagent; correction needs the lot's own impurities, a row for each channel.

    Of the 10plex a channel's impurities fall into its own series only: 126, 127C .. 130C, or 127N .. 131.
    """
    if impurities is not None and len(impurities) != len(TMT_LABELS[reagent]):
        raise ValueError(f"{reagent} has {len(TMT_LABELS[reagent])} channels")
    return IsobaricTag(reagent, TMT_REPORTERS[reagent, fragmentation], TMT_LABELS[reagent], impurities, stride=2 if reagent == "TMT10plex" else 1)


def reporter_ions(mz: Column, intensity: Column, targets: list[float], tolerance: float) -> Column:
    """array<struct<mz,i>>: for each target the nearest ion within the relative tolerance (of equals the first), else (NaN, 0)."""
    ions = F.transform(F.arrays_zip(mz.alias("m"), intensity.alias("v")), lambda x, k: F.struct(x["m"].alias("m"), x["v"].alias("v"), k.alias("k")))
    none = F.struct(F.lit(float("nan")).alias("mz"), F.lit(0.0).alias("i"))

    def nearest(target: Column) -> Column:
        near = F.filter(ions, lambda x: F.abs(x["m"] - target) <= target * tolerance)
        best = F.array_min(F.transform(near, lambda x: F.struct(F.abs(x["m"] - target).alias("d"), x["k"].alias("k"), x["m"].alias("mz"), x["v"].alias("i"))))
        return F.when(best.isNotNull(), F.struct(best["mz"].alias("mz"), best["i"].cast("double").alias("i"))).otherwise(none)

    return F.transform(F.array(*[F.lit(t) for t in targets]), nearest)


def corrected_column(intensities: Column, tag: IsobaricTag) -> Column:
    """Intensities without the impurities' share, none of them negative: all rows of a batch are solved together."""
    matrix = tag.matrix

    @F.arrow_udf("array<double>")
    def correct(rows: pa.Array) -> pa.Array:
        there = np.flatnonzero(~np.asarray(rows.is_null()))
        values = np.asarray(rows.take(pa.array(there)).flatten(), float).reshape(len(there), -1) if len(there) else np.zeros((0, matrix.shape[0]))
        bounds = np.zeros(len(rows) + 1, np.int32)
        bounds[there + 1] = matrix.shape[1]
        missing = np.ones(len(rows), bool)
        missing[there] = False
        return pa.ListArray.from_arrays(pa.array(np.cumsum(bounds), pa.int32()), pa.array(nnls_rows(matrix, values).ravel()), mask=pa.array(missing))

    return correct(intensities)
