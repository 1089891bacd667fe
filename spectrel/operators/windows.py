"""Row windows: running averages and islands of continuous values. Groups may be of any size (``ordered``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .ordered import islands, null_safe_join, numbered, running


def mass_time_islands(table: DataFrame, mass: str, time: str, mass_limit: float, time_limit: float, order: list[str], by: list[str], into: str = "island") -> DataFrame:
    """Islands by mass, in these by time, and in those by mass again; ``into`` numbers them in each group of ``by``."""
    first = islands(table, mass, mass_limit, order, by, "_a")
    second = islands(first, time, time_limit, order, [*by, "_a"], "_b")
    third = islands(second, mass, mass_limit, order, [*by, "_a", "_b"], "_c")
    # islands are numbered by a table of one row for each
    steps = ["_a", "_b", "_c"]
    names = numbered(third.select(*by, *steps).distinct(), by, steps, into)
    return null_safe_join(third, names, [*by, *steps]).drop(*steps)


__all__ = ["islands", "mass_time_islands", "running"]
