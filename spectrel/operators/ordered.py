"""Row numbers, islands and running values of tables whose groups may be larger than a task.

A table is split into ranges of (group, order), so a group of any size lies in several neighbouring ranges, and a window
never spans more than one range. What a range needs to know of those before it (how many rows or new islands of its first
group there are, and that group's last value) is one row a range and group, summed over ranges. The ranges are written to
the shared folder first: they come from a sample, and all passes have to see the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .tables import stored

#: Rows of a block of running values, if their frame isn't longer.
BLOCK = 1 << 14

Order = list[str | Column]


def ranges(table: DataFrame, by: list[str], order: Order) -> DataFrame:
    """The table with ``_part``, the number of the range that holds a row."""
    keys = [*by, *order]
    return stored(table.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")


def _windows(by: list[str], order: Order) -> tuple[WindowSpec, WindowSpec]:
    """Rows of a range and group, and the ranges of a group before each (one row a range)."""
    return Window.partitionBy("_part", *by).orderBy(*order), Window.partitionBy(*by or [F.lit(0)]).orderBy("_part")


def null_safe_join(table: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both with equal keys, where null keys meet null keys."""
    other = other.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return table.join(other, same).drop(*[f"_r_{k}" for k in keys])


def numbered(table: DataFrame, by: list[str], order: Order, into: str = "position") -> DataFrame:
    """Row numbers from 0 in each group of ``by``; without any, of the whole table. ``order`` should leave no ties."""
    placed = ranges(table, by, order)
    rows, before = _windows(by, order)
    counts = placed.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = placed.withColumn(into, F.row_number().over(rows) - F.lit(1))
    found = null_safe_join(own, counts.withColumn("_earlier", earlier).drop("_n"), ["_part", *by])
    return found.withColumn(into, (F.col(into) + F.col("_earlier")).cast("long")).drop("_part", "_earlier")


def islands(table: DataFrame, value: str, limit, order: list[str], by: list[str], into: str = "island") -> DataFrame:
    """Numbers of the groups of values whose neighbours differ by no more than ``limit``; from 0, in each group of ``by``.

    Null values come first and are one island with the value after them.
    """
    placed = ranges(table, by, [value, *order])
    rows, before = _windows(by, [value, *order])
    keys = ["_part", *by]
    last = placed.groupBy(*keys).agg(F.max(value).alias("_last"))
    # a range of nulls alone has no last value, but then there is none before it either
    last = last.withColumn("_before", F.lag("_last").over(before)).drop("_last")
    previous = F.when(F.row_number().over(rows) == 1, F.col("_before")).otherwise(F.lag(value).over(rows))
    marked = null_safe_join(placed, last, keys).withColumn("_previous", previous).drop("_before")
    marked = marked.withColumn("_new", F.coalesce(F.col(value) - F.col("_previous") > limit, F.lit(False)).cast("long")).drop("_previous")
    news = marked.groupBy(*keys).agg(F.sum("_new").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = marked.withColumn(into, F.sum("_new").over(rows.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    found = null_safe_join(own, news.withColumn("_earlier", earlier).drop("_n"), keys)
    return found.withColumn(into, F.col(into) + F.col("_earlier")).drop("_part", "_earlier")


def beside(table: DataFrame, by: list[str], order: list[str], value: str, before: str, after: str) -> DataFrame:
    """The last ``value`` of the rows before each in its group of ``by``, and the first of those after it; nulls are passed over."""
    placed = ranges(table, by, order)
    keys = ["_part", *by]
    turn = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = placed.groupBy(*keys).agg(F.min_by(value, turn).alias("_first"), F.max_by(value, turn).alias("_last"))
    forth, back = (Window.partitionBy(*by or [F.lit(0)]).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_part"), F.desc("_part")))
    ends = ends.select(*keys, F.last("_last", True).over(forth).alias("_earlier"), F.last("_first", True).over(back).alias("_later"))
    # both windows look back, as one that looks ahead would start anew at each row
    forth, back = (Window.partitionBy(*keys).orderBy(*[f(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1) for f in (F.asc, F.desc))
    found = null_safe_join(placed, ends, keys)
    return found.withColumns({before: F.coalesce(F.last(value, True).over(forth), "_earlier"), after: F.coalesce(F.last(value, True).over(back), "_later")}).drop("_part", "_earlier", "_later")


def running(table: DataFrame, value: str, m: int, order: list[str], by: list[str], kind: str = "median", into: str = "running", middle: str | None = None) -> DataFrame:
    """Mean or median of each ``m`` rows in a row; the first m - 1 rows of a group have none and are left out.

    A window is known by its last row; of the column ``middle`` it has the value of the row in its middle (of two, the later).
    Rows are dealt into blocks by their numbers, and the last m - 1 rows of a block are also sent to the next one.
    """
    size = max(BLOCK, m)
    placed = numbered(table, by, order, "_n")
    block = F.floor(F.col("_n") / size)
    late = F.col("_n") % size > size - m
    sent = placed.withColumn("_block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    rows = Window.partitionBy(*by, "_block").orderBy("_n")
    f = F.percentile(value, 0.5) if kind == "median" else F.avg(value)
    found = sent.withColumn(into, f.over(rows.rowsBetween(-(m - 1), 0)))
    if middle:
        found = found.withColumn(middle, F.lag(middle, (m - 1) // 2).over(rows))
    return found.where((F.col("_block") == block) & (F.col("_n") >= m - 1)).drop("_n", "_block")
