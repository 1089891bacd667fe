"""Deviations as smooth functions of a position, fitted by aggregation: no group of points is ever in one task.

A group's positions are divided into cells of equal width. Of each cell the points leave only sums of powers: of the
position within the cell, and of it times the deviation. A spline whose knots are borders of cells is a polynomial in each
cell, so these sums hold all that its normal equations need, whichever borders become knots. What is fitted in one task
is as long as a group has cells, whatever its points; what is fitted comes back as one polynomial a cell, and a position
finds its own by an equal join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import cell_polynomials
from .ordered import null_safe_join, running
from .tables import stored

DEGREE = 2
#: Points that are added beyond each end, at the deviation of the end.
MARGIN = 100


def fit(points: DataFrame, by: list[str], position: str, deviation: str, order: list[str], window: int = 10, cells: int | None = None, cycles: int = 10, share: float = 0.4, least: int = 10, expansion: float = 0.1, fewest: int = 1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Models of the groups of ``by``: (by, start, width, cells), and (by, cell, a0, a1, a2).

    Deviations are smoothed by running medians of ``window`` points in the order of position and ``order`` (that of a window
    belongs to its middle), and continued beyond both ends by ``expansion`` of their range. Each of ``cycles`` splines is
    fitted on a ``share`` of the points, chosen by their hashes, with at least ``least`` of them between two knots; the
    model is their mean. Without ``cells`` a cell is about one unit of the position wide. Groups of fewer than ``fewest``
    points, or than a window, have no model; points without a position or deviation don't count.
    """
    known = points.where(F.col(position).isNotNull() & F.col(deviation).isNotNull() & ~F.isnan(position) & ~F.isnan(deviation))
    known = known.select(*by, *order, F.col(position).cast("double").alias("_x"), F.col(deviation).cast("double").alias("_y"))
    counts = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_count"), (F.max("_x") - F.min("_x")).alias("_range")).where(F.col("_count") >= fewest)
    smooth = running(known, "_y", window, ["_x", *order], by, "median", "_s", middle="_x")
    smooth = stored(smooth.select(*by, *order, "_x", F.col("_s").alias("_y")), "smooth")
    ends = smooth.groupBy(*by).agg(*[f("_x").alias(n) for f, n in ((F.min, "_low"), (F.max, "_high"))], *[f("_y", F.struct("_x", *order)).alias(n) for f, n in ((F.min_by, "_first"), (F.max_by, "_last"))])
    reach = (F.col("_high") - F.col("_low")) * expansion
    number = F.lit(cells) if cells else F.greatest(F.lit(2), F.floor("_range"))
    width = (F.col("_high") - F.col("_low") + 2 * reach) / F.col("cells")
    frames = null_safe_join(ends, counts, by).withColumn("cells", number.cast("int"))
    frames = frames.select(*by, (F.col("_low") - reach).alias("start"), F.when(width > 0, width).otherwise(1.0).alias("width"), "cells", "_low", "_high", "_first", "_last", reach.alias("_reach"))
    frames = stored(frames, "frames")
    step = F.explode(F.sequence(F.lit(1), F.lit(MARGIN))).alias("_i")
    beyond = frames.select(*by, "_low", "_high", "_first", "_last", "_reach", step)
    beyond = beyond.select(*by, F.explode(F.array(*[
        F.struct((F.col(end) + sign * F.col("_reach") * F.col("_i") / MARGIN).alias("_x"), F.col(y).alias("_y"), (sign * F.col("_i")).cast("int").alias("_k")) for end, y, sign in (("_low", "_first", -1), ("_high", "_last", 1))
    ])).alias("p")).select(*by, "p.*")
    every = smooth.withColumn("_k", F.lit(0)).unionByName(beyond, allowMissingColumns=True)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(cycles - 1)), lambda c: F.pmod(F.xxhash64(F.lit(seed), c, "_x", "_k", *order), F.lit(1000)) < round(share * 1000))
    drawn = null_safe_join(every.withColumn("_cycle", F.explode(chosen)), frames.select(*by, "start", "width", "cells"), by)
    at = (F.col("_x") - F.col("start")) / F.col("width")
    drawn = drawn.withColumn("cell", F.greatest(F.lit(0), F.least(F.col("cells") - 1, F.floor(at).cast("int")))).withColumn("_u", at - F.col("cell"))
    powers = [F.sum(F.pow("_u", F.lit(float(k)))).alias(f"m{k}") for k in range(2 * DEGREE + 1)] + [F.sum(F.pow("_u", F.lit(float(k))) * F.col("_y")).alias(f"r{k}") for k in range(DEGREE + 1)]
    sums = drawn.groupBy(*by, "_cycle", "cell").agg(F.first("cells").alias("cells"), *powers)
    polynomials = [f"a{k}" for k in range(DEGREE + 1)]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        found = cell_polynomials(rows["cell"].to_numpy(), rows[[f"m{k}" for k in range(2 * DEGREE + 1)]].to_numpy(float), rows[[f"r{k}" for k in range(DEGREE + 1)]].to_numpy(float), int(rows["cells"].iloc[0]), least)
        out = pd.DataFrame(found, columns=polynomials)
        out.insert(0, "cell", np.arange(len(found), dtype=np.int32))
        for c in by:
            out[c] = rows[c].iloc[0]
        return out[[*by, "cell", *polynomials]]

    kinds = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "cell int", *[f"{c} double" for c in polynomials]])
    each = sums.groupBy(*by, "_cycle").applyInPandas(solve, schema)
    return frames.select(*by, "start", "width", "cells"), stored(each.groupBy(*by, "cell").agg(*[F.avg(c).alias(c) for c in polynomials]), "polynomials")


def predict(table: DataFrame, model: tuple[DataFrame, DataFrame], by: list[str], position: str, into: str = "deviation") -> DataFrame:
    """The table with the deviation at each position; beyond the ends that of the end, null without a model or a position."""
    frames, polynomials = model
    named = lambda t: t.withColumnsRenamed({c: f"_f_{c}" for c in t.columns})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    placed = table.join(named(frames), same, "left")
    at = (F.col(position) - F.col("_f_start")) / F.col("_f_width")
    placed = placed.withColumn("_at", F.when(at.isNotNull(), F.greatest(F.lit(0.0), F.least(at, F.col("_f_cells").cast("double"))))).drop(*[f"_f_{c}" for c in by], "_f_start", "_f_width")
    placed = placed.withColumn("_cell", F.least(F.floor("_at").cast("int"), F.col("_f_cells") - 1)).drop("_f_cells")
    joined = placed.join(named(polynomials), same & (F.col("_cell") == F.col("_f_cell")), "left")
    u = F.col("_at") - F.col("_cell")
    value = F.col(f"_f_a{DEGREE}")
    for k in reversed(range(DEGREE)):
        value = value * u + F.col(f"_f_a{k}")
    return joined.withColumn(into, value).drop("_at", "_cell", *[f"_f_{c}" for c in polynomials.columns])
