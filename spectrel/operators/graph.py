"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step groups edges by node and keeps only the group's minimum, so no neighbour list is ever built, and the table
never grows beyond the edges. Large groups are split: minima are pre-aggregated before the shuffle, and the join that
brings a node's minimum back to its edges is an ordinary one, which Spark splits where a node is hot. Each round's edges
are written to the shared folder, so lost executors cost that round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _minima(pairs: DataFrame) -> DataFrame:
    """For each u its least neighbour or itself."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a stored table, and their number and a sum of their hashes."""
    now = stored(edges, "edges")
    state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return now, (state["n"], state["h"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: longs or strings); the component is its least node.

    Loops, repeated edges and nulls are dropped. An empty table gives no rows.
    """
    now, before = _kept(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above u hang on the least neighbour of u
        large = both.where("v > u").join(_minima(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u, and u itself, hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        now, state = _kept(small.where("u <> v").distinct())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
