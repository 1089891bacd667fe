"""Joins by tolerance. Values are put into bins at least as wide as the tolerance, so rows meet by equal bins, never each with each."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import beside, numbered
from .tables import stored


def _bin(value: Column, tolerance: float, mode: str) -> Column:
    if mode == "relative":
        return F.floor(F.log(value) / math.log1p(2 * tolerance))
    return F.floor(value / (tolerance if tolerance > 0 else 1.0))


def tolerance_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float, mode: str = "relative", on: list[str] | None = None) -> DataFrame:
    """Rows whose right value lies within the tolerance around the left value (closed), and whose ``on`` columns are equal.

    Relative tolerances ask for positive values. Each left row is sent to three bins, whatever the data.
    """
    near = left.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _bin(F.col(left_value), tolerance, mode) + d)))
    other = right.withColumn("_bin", _bin(F.col(right_value), tolerance, mode))
    return near.join(other, [*(on or []), "_bin"]).drop("_bin").where(_within(F.col(left_value), F.col(right_value), tolerance, mode))


def _within(a: Column, b: Column, tolerance: float, mode: str) -> Column:
    reach = a * tolerance if mode == "relative" else F.lit(tolerance)
    return (b >= a - reach) & (b <= a + reach)


def _neighbours(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float, mode: str, on: list[str], ties: list[str]) -> DataFrame:
    """Of the pairs of ``tolerance_join`` those that can be the nearest: with the next values below (or equal) and above a left row's.

    Of equal right values the first by ``ties`` stands for all. Both sides are put into one order, so no pairs are made.
    """
    usable = lambda df, value: df.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*on, value)], F.col(value) > 0 if mode == "relative" else F.lit(True)))
    best = usable(right, right_value).groupBy(*on, F.col(right_value).alias("_value")).agg(F.min_by(F.struct(*right.columns), F.struct(*ties)).alias("_right"))
    best = beside(best, on, ["_value"], "_value", "_previous", "_next")
    hits = best.select(*on, "_value", F.lit(0).alias("_turn"), F.struct("_right", "_previous", "_next").alias("_hit"))
    asked = usable(left, left_value).select(*on, F.col(left_value).alias("_value"), F.lit(1).alias("_turn"), F.struct(*left.columns).alias("_left"))
    near = beside(hits.unionByName(asked, allowMissingColumns=True), on, ["_value", "_turn"], "_hit", "_below", "_above")
    near = stored(near.where("_turn = 1").select("_left", "_below", "_above"), "near")
    columns = [c for c in right.columns if c not in on]
    each = near.select("_left", F.explode(F.array("_below", "_above")).alias("_hit")).where("_hit is not null")
    pairs = each.select(*[F.col("_left")[c].alias(c) for c in left.columns], *[F.col("_hit._right")[c].alias(c) for c in columns])
    pairs = pairs.where(_within(F.col(left_value), F.col(right_value), tolerance, mode))
    # values so close that their distances round to the same: there ties decide among all of them
    gap = lambda value: F.abs(value - F.col("_left")[left_value])
    same = (gap(F.col("_below._previous")) == gap(F.col("_below._right")[right_value])) | (gap(F.col("_above._next")) == gap(F.col("_above._right")[right_value]))
    unclear = near.where(same).select("_left.*")
    if unclear.isEmpty():
        return pairs
    return pairs.unionByName(tolerance_join(unclear, right, left_value, right_value, tolerance, mode, on).select(*pairs.columns))


def nearest_match(left: DataFrame, right: DataFrame, key: list[str], left_value: str, right_value: str, tolerance: float, mode: str = "relative", on: list[str] | None = None, ties: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """For each left row (known by ``key``) the right row of nearest value within the tolerance; of equals the first by ``ties``.

    A condition ``where`` on pairs asks for all of them; without one, neighbours in the order of values are enough.
    """
    if where is None:
        pairs = _neighbours(left, right, left_value, right_value, tolerance, mode, on or [], ties or [right_value])
    else:
        pairs = tolerance_join(left, right, left_value, right_value, tolerance, mode, on).where(where)
    w = Window.partitionBy(*key).orderBy(F.abs(F.col(right_value) - F.col(left_value)), *(ties or [right_value]))
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def bounds_within(left: DataFrame, right: DataFrame, key: list[str], left_value: str, right_value: str, tolerance: float, mode: str, order: list[str]) -> DataFrame:
    """For each left row the first position, and the one after the last, of right values within the tolerance; no match: nulls.

    Positions count the right rows from 0 by value and then ``order``, whatever their number (``ordered.numbered``). Values
    within a tolerance are neighbours in that order, so equal values needn't meet the left rows one by one: each distinct
    value brings its first and last position.
    """
    placed = numbered(right.select(right_value, *order), [], [right_value, *order], "_position")
    spans = placed.groupBy(right_value).agg(F.min("_position").alias("_low"), F.max("_position").alias("_high"))
    hits = tolerance_join(left, spans, left_value, right_value, tolerance, mode).groupBy(*key).agg(F.min("_low").alias("low"), (F.max("_high") + 1).alias("high"))
    return left.join(hits, key, "left")
