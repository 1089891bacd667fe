"""Counts of the boxes that points meet, without a list of pairs.

A box is a mass with a range of time, a point a time with a tolerance around its mass. Points and boxes are dealt into cells
of mass and time: a point lies in one, a box is sent to all from which a point can meet it. In a cell, the boxes are sorted
by mass, so a point meets those in a range of positions that have begun by its time, less those that have ended before.
Both are counted bit by bit of their ranks, for all points at once, so dense cells cost a logarithm of their boxes a point.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .tables import stored

#: Points and boxes that a cell has on average.
ROWS = 1 << 17

#: Points of a cell that one task takes at once; a cell of more is dealt over several, each with all its boxes.
POINTS = 1 << 18

_LARGEST = 1.7e308


def _below(ranks: np.ndarray, bound: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the number, and the sum of the positions, of ranks under ``bound`` at positions from ``first`` to before ``end``."""
    at = np.arange(len(ranks))
    count, total = np.zeros(len(bound), np.int64), np.zeros(len(bound), np.int64)
    for bit in reversed(range(len(ranks).bit_length())):
        one = (ranks >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        sums = np.concatenate([[0], np.cumsum(np.where(one, 0, at))])
        above = (bound >> bit) & 1 == 1
        low, high = zeros[first], zeros[end]
        count += np.where(above, high - low, 0)
        total += np.where(above, sums[end] - sums[first], 0)
        first = np.where(above, zeros[-1] + first - low, low)
        end = np.where(above, zeros[-1] + end - high, high)
        order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        ranks, at = ranks[order], at[order]
    return count, total


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted values, and the place of each in them."""
    order = np.argsort(values, kind="stable")
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.arange(len(values))
    return values[order], ranks


def _met(mass: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the number of boxes (by ascending mass, no empty ranges) that it meets, and the sum of their positions."""
    first = np.searchsorted(mass, least, "left")
    end = np.maximum(first, np.searchsorted(mass, most, "right"))
    begins, begin_ranks = _ranks(low)
    ends, end_ranks = _ranks(high)
    begun, begun_at = _below(begin_ranks, np.searchsorted(begins, time, "right"), first, end)
    over, over_at = _below(end_ranks, np.searchsorted(ends, time, "left"), first, end)
    return begun - over, begun_at - over_at


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().to_numpy(zero_copy_only=False)


def meetings(points: DataFrame, boxes: DataFrame, on: list[str], key: str, value: Column, time: str, tolerance: float, mode: str) -> DataFrame:
    """The points with ``wide`` and ``tight``, how many boxes of equal ``on`` columns they meet, and ``only_wide`` and ``only_tight``, the box (its ``id``) where that is one.

    ``boxes``: on, id, mass, low, high, inner_low, inner_high; a box is met if its mass lies within the tolerance of the
    point's ``value`` (as in ``rangejoin``) and the point's time from low to high, tightly if from inner_low to inner_high
    too. ``points`` and ``boxes`` are read several times, so they should be stored; ``key`` deals the points of a large cell.
    """
    if mode == "relative" and tolerance >= 1:
        raise ValueError("a relative tolerance must be below 1")
    if mode == "relative":
        side = math.log1p(8 * max(tolerance, 1e-6))
        place = lambda c: F.log(c) / side
        around = [F.col("mass") / (1 + tolerance), F.col("mass") / (1 - tolerance)]
    else:
        side = 4 * tolerance if tolerance > 0 else 1.0
        place = lambda c: c / side
        around = [F.col("mass") - tolerance, F.col("mass") + tolerance]
    boxes = boxes.where((F.col("low") <= F.col("high")) & F.col("mass").isNotNull())
    finite = lambda c: F.when(F.abs(c) < _LARGEST, F.col(c))
    values = F.approx_count_distinct(F.struct(*on, F.floor(place(F.col("mass")))))
    start, stop, n, values = boxes.agg(F.min(F.least(finite("low"), finite("high"))), F.max(F.greatest(finite("low"), finite("high"))), F.count(F.lit(1)), values).first()
    start, stop = (0.0, 0.0) if start is None else (float(start), float(stop))
    # times beyond all finite edges count as the nearest of those, so boxes without an end lie in a bounded number of cells
    clamped = lambda c: F.least(F.greatest(F.col(c), F.lit(start)), F.lit(stop))
    long = boxes.agg(F.avg(clamped("high") - clamped("low"))).first()[0] or 0.0
    # as many ranges of time as leave ROWS in a cell, on average, but none shorter than the mean box
    ranges = math.ceil((n + points.count()) / ROWS / max(values, 1)) or 1
    long = max(long, (stop - start) / ranges) or 1.0
    when = lambda c: F.floor((clamped(c) - start) / long)
    # rounding must not keep a box from a cell; the exact comparison comes in the cell
    slack = F.abs(place(F.col("mass"))) * 1e-12 + 1e-6
    cell = [*on, "_value_cell", "_time_cell"]
    own = points.withColumns({"_value": value.cast("double"), "_time": F.col(time).cast("double")})
    own = own.withColumns({"_value_cell": F.floor(place(F.col("_value"))), "_time_cell": when("_time")})
    lost = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*cell, "_time")])
    none = F.lit(0).cast("long")
    idle = own.where(lost).select(*points.columns, none.alias("wide"), none.alias("tight"), *[F.lit(None).cast(boxes.schema["id"].dataType).alias(f"only_{c}") for c in ("wide", "tight")])
    own = own.where(~lost)
    sent = boxes.withColumn("_value_cell", F.explode(F.sequence(F.floor(place(around[0]) - slack), F.floor(place(around[1]) + slack))))
    sent = sent.withColumn("_time_cell", F.explode(F.sequence(when("low"), when("high")))).dropna(subset=cell)
    large = stored(own.groupBy(*cell).count().where(F.col("count") > POINTS).withColumn("_parts", F.ceil(F.col("count") / POINTS)).drop("count"), "cells")
    if not large.isEmpty():
        own = own.join(large, cell, "left").withColumn("_part", F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1)))).drop("_parts")
        sent = sent.join(large, cell, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        cell = [*cell, "_part"]
    columns = points.columns
    schema = StructType([*points.schema.fields, StructField("wide", LongType()), StructField("tight", LongType()), *[StructField(f"only_{c}", boxes.schema["id"].dataType) for c in ("wide", "tight")]])

    def of_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        a, t = _numbers(left, "_value"), _numbers(left, "_time")
        reach = a * tolerance if mode == "relative" else tolerance
        order = np.argsort(_numbers(right, "mass"), kind="stable")
        mass, low, high, inner_low, inner_high = (_numbers(right, c)[order].astype(float) for c in ("mass", "low", "high", "inner_low", "inner_high"))
        out = left.select(columns)
        found = {}
        # NaN is the greatest number, here as in Spark's comparisons
        inside = (inner_low <= inner_high) | np.isnan(inner_high)
        for name, some, begin, end in (("wide", slice(None), low, high), ("tight", inside, inner_low, inner_high)):
            n, at = _met(mass[some], begin[some], end[some], a - reach, a + reach, t)
            place_of = order[some]
            only = np.zeros(len(n), np.int64)
            only[n == 1] = place_of[at[n == 1]]
            found[name] = n
            found[f"only_{name}"] = right["id"].combine_chunks().take(pa.array(only, mask=n != 1))
        for name in ("wide", "tight", "only_wide", "only_tight"):
            out = out.append_column(name, pa.array(found[name]) if isinstance(found[name], np.ndarray) else found[name])
        return out.cast(pa.schema([(f.name, out.schema.field(f.name).type) for f in out.schema]))

    return own.groupBy(*cell).cogroup(sent.groupBy(*cell)).applyInArrow(of_cell, schema).unionAll(idle)
