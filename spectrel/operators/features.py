"""LC-MS features: matching with spectra, retention time alignment, label-free grouping."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants
from ..functions.masses import overlaps, relative_mass_to_log2
from . import splines
from .ordered import null_safe_join, numbered
from .rangejoin import nearest_match
from .stabbing import meetings
from .tables import stored
from .windows import mass_time_islands

# ---------------------------------------------------------------- matching


def match_features(spectra: DataFrame, features: DataFrame, tolerance: float, mode: str = "relative", isotope_errors: tuple[int, ...] = (0,), before: float = -0.05, after: float = 0.10, match_charge: bool = True, isotope_step: float = constants.ISOTOPE_STEP, keys: tuple[str, ...] = ("specfile",), keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys, specId, keep, error, single, featureId) for spectra that meet features.

    ``spectra``: keys, specId (each once), mass, rt, charge, and columns to ``keep``; ``features``: keys, featureId, mass,
    rtLow, rtHigh, charge. Isotope errors are tried in order. A feature is met if its mass is within the tolerance of the
    shifted spectrum mass, and the spectrum's time in its range, widened by the shares ``before`` and ``after`` of its width.
    Do several meet, only the range as it is counts. The first error with one feature left matches it (``single``); one with
    several ends the search without a match. Spectra without a charge take no part.

    Features met are counted and never listed (``stabbing``); only spectra that are left without any try the next error.
    """
    on = [*keys, *(["charge"] if match_charge else [])]
    own = list(dict.fromkeys([*keys, "specId", "mass", "rt", "charge", *keep]))
    waiting = stored(spectra.where("charge is not null").select(*own), "spectra")
    width = F.col("rtHigh") - F.col("rtLow")
    boxes = features.select(*on, F.col("featureId").alias("id"), "mass", "rtLow", "rtHigh", (F.col("rtLow") + width * before).alias("low"), (F.col("rtHigh") + width * after).alias("high"))
    boxes = stored(boxes.select(*on, "id", "mass", "low", "high", F.greatest("low", "rtLow").alias("inner_low"), F.least("high", "rtHigh").alias("inner_high")), "features")
    found = []
    for n, error in enumerate(map(float, isotope_errors)):
        wanted = F.col("mass") + F.lit(error) * isotope_step / F.col("charge")
        met = meetings(waiting, boxes, on, "specId", wanted, "rt", tolerance, mode)
        met = met.withColumn("left", F.when(F.col("wide") > 1, F.col("tight")).otherwise(F.col("wide")))
        if n < len(isotope_errors) - 1:
            met = stored(met, "met")
            waiting = met.where("left = 0").select(*own)
        only = F.when(F.col("left") == 1, F.when(F.col("wide") > 1, F.col("only_tight")).otherwise(F.col("only_wide")))
        found.append(met.where("left > 0").select(*keys, "specId", *keep, F.lit(error).alias("error"), (F.col("left") == 1).alias("single"), only.alias("featureId")))
    return reduce(DataFrame.unionAll, found)


def best_annotations(matches: DataFrame, psms: DataFrame, keys: tuple[str, ...] = ("specfile",), larger_better: bool = False) -> DataFrame:
    """For each matched feature: spectra met, and the best (score, peptide, sequence) of them."""
    joined = matches.where("single").select(*keys, "specId", "featureId").join(psms.select(*keys, "specId", "score", "peptide", "sequence"), [*keys, "specId"])
    return best_of(joined, keys, larger_better)


def best_of(annotated: DataFrame, keys: tuple[str, ...] = ("specfile",), larger_better: bool = False) -> DataFrame:
    """The same for single matches that have score, peptide and sequence already."""
    entry = F.struct("score", "peptide", "sequence")
    best = F.max(entry) if larger_better else F.min(entry)
    return annotated.groupBy(*keys, "featureId").agg(F.array_sort(F.collect_list("specId")).alias("specIds"), best.alias("b")).select(*keys, "featureId", "specIds", "b.*")


def annotate_features(features: DataFrame, matches: DataFrame, best: DataFrame, keys: tuple[str, ...] = ("specfile",)) -> DataFrame:
    """Features with isMatched, isAnnotated, and the best annotation in peptide, sequence, score."""
    met = matches.where("single").select(*keys, F.col("featureId").alias("id")).distinct().withColumn("_m", F.lit(True))
    ann = best.select(*keys, F.col("featureId").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("specIds", "score", "peptide", "sequence")])
    joined = features.join(met, [*keys, "id"], "left").join(ann, [*keys, "id"], "left")
    return joined.withColumns(
        {
            "isMatched": F.coalesce("_m", F.lit(False)), "isAnnotated": F.col("_peptide").isNotNull(), "siiIds": F.coalesce("_specIds", F.array().cast("array<string>")),
            "score": F.col("_score"), "peptide": F.col("_peptide"), "sequence": F.col("_sequence"),
        }
    ).drop("_m", "_specIds", "_score", "_peptide", "_sequence")


def match_statistics(features: DataFrame, matches: DataFrame, spectra: DataFrame, keys: tuple[str, ...] = ("specfile",)) -> DataFrame:
    """One row: features, features matched, spectra, spectra matched, and both shares (null where there is nothing)."""
    f = features.agg(F.count("*").alias("features"))
    s = spectra.agg(F.count("*").alias("spectra"))
    m = matches.where("single").agg(F.countDistinct(*keys, "featureId").alias("matched_features"), F.count("*").alias("matched_spectra"))
    one = f.crossJoin(s).crossJoin(m)  # three tables of one row
    return one.withColumns({"feature_share": F.try_divide("matched_features", "features"), "spectrum_share": F.try_divide("matched_spectra", "spectra")})


# ---------------------------------------------------------------- alignment


def deviations(features: DataFrame, reference: str, rt_limit: float = 60, mz_limit_ppm: float = 2.5, least_intensity: float | None = 1e5) -> DataFrame:
    """For each feature of other runs the reference's feature of nearest m/z (equal charge, both limits): rt, rtDev, mzDevRel."""
    some = features if least_intensity is None else features.where(F.col("intensity") > least_intensity)
    ref = some.where(F.col("specfile") == reference).select("charge", F.col("mz").alias("refMz"), F.col("rt").alias("refRt"))
    own = some.where(F.col("specfile") != reference).select("specfile", "id", "charge", "mz", "rt")
    close = F.abs(F.col("refRt") - F.col("rt")) <= rt_limit
    best = nearest_match(own, ref, ["specfile", "id"], "mz", "refMz", mz_limit_ppm * 1e-6, "relative", ["charge"], ["refRt"], close)
    return best.select("specfile", "id", "rt", (F.col("rt") - F.col("refRt")).alias("rtDev"), ((1 - F.col("mz") / F.col("refMz")) * 1e6).alias("mzDevRel"))


#: Matches that a run needs to be aligned.
LEAST_MATCHES = 40


def calibrate_rt(features: DataFrame, reference: str, seed: int = 1, **limits) -> DataFrame:
    """rt of all runs aligned to a reference run; the original stays in obsRt, if there is such a column.

    A run's deviation from the reference is a spline of its matches with knots at full seconds or further apart, fitted by
    sums (``splines``). Runs of fewer than LEAST_MATCHES matches, and features without a time, stay as they are.
    """
    found = deviations(features, reference, **limits).withColumnRenamed("id", "_id")
    model = splines.fit(found, ["specfile"], "rt", "rtDev", ["_id"], expansion=0.2, fewest=LEAST_MATCHES, seed=seed)
    moved = splines.predict(features, model, ["specfile"], "rt", "_shift")
    changed = {"rt": F.col("rt") - F.coalesce("_shift", F.lit(0.0))}
    if "obsRt" in features.columns:
        changed["obsRt"] = F.coalesce("obsRt", "rt")
    return moved.withColumns(changed).select(*[F.col(f"`{c}`") for c in features.columns])


# ---------------------------------------------------------------- grouping


#: Of a cell and the eight around it those that it looks into, so that two cells meet once.
_AROUND = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


def _meeting(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (_island, _x, _y, columns) with those of their own cell and of the cells around, each pair of cells once: a_ and b_ columns."""
    around = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _AROUND])
    left = table.select(*[F.col(c).alias(f"a{c}") for c in ("_island", "_x", "_y", *columns)], F.explode(around).alias("_to"))
    right = table.select(*[F.col(c).alias(f"b{c}") for c in ("_island", "_x", "_y", *columns)])
    left = left.withColumns({"_to_x": F.col("a_x") + F.col("_to.x"), "_to_y": F.col("a_y") + F.col("_to.y")})
    same = (F.col("_to_x") == F.col("b_x")) & (F.col("_to_y") == F.col("b_y")) & (F.col("a_island") == F.col("b_island"))
    return left.join(right, same).withColumn("_own", (F.col("_to.x") == 0) & (F.col("_to.y") == 0)).drop("_to", "_to_x", "_to_y")


def _distance() -> Column:
    return F.sqrt((F.col("a_t") - F.col("b_t")) * (F.col("a_t") - F.col("b_t")) + (F.col("a_m") - F.col("b_m")) * (F.col("a_m") - F.col("b_m")))


def _edge() -> Column:
    return F.struct("d", F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def _in_cells(nodes: DataFrame, limit: float) -> DataFrame:
    """Nodes with their square cell, as wide as the limit."""
    side = limit if limit > 0 else 1.0
    return nodes.withColumns({"_x": F.floor(F.col("_t") / side), "_y": F.floor(F.col("_m") / side)})


def _close_pairs(nodes: DataFrame, limit: float) -> DataFrame:
    """(x, y, island, e): pairs x < y of nodes (_node, _island, _t, _m, _c) of one island, of different categories, at most ``limit`` apart; e is (d, a, b), distance and nodes."""
    met = _meeting(_in_cells(nodes, limit), ["_node", "_t", "_m", "_c"]).where((~F.col("_own") | (F.col("a_node") < F.col("b_node"))) & (F.col("a_c") != F.col("b_c")))
    close = met.withColumn("d", _distance()).where(F.col("d") <= limit)
    return close.select(_edge().alias("e"), F.col("a_island").alias("island")).select("e.a", "e.b", "island", "e").toDF("x", "y", "island", "e")


def _close_groups(nodes: DataFrame, groups: DataFrame, done: float, limit: float) -> DataFrame:
    """(x, y, island, e): the shortest edge over ``done`` and up to ``limit`` between two groups that share no category.

    Groups meet in cells first, once each, and only those without a common category show their nodes in these cells.
    """
    placed = _in_cells(nodes, limit)
    spots = stored(placed.select("_island", "_root", "_x", "_y").distinct(), "spots")
    ends = [F.least("a_root", "b_root").alias("x"), F.greatest("a_root", "b_root").alias("y")]
    met = _meeting(spots, ["_root"]).where(F.when(F.col("_own"), F.col("a_root") < F.col("b_root")).otherwise(F.col("a_root") != F.col("b_root"))).select("*", *ends)
    apart = stored(_apart(met.select("x", "y").distinct(), groups), "apart")
    near = met.join(apart, ["x", "y"])
    for side in "ab":
        points = placed.select(*[F.col(c).alias(f"{side}{c}") for c in ("_root", "_x", "_y", "_node", "_t", "_m")])
        near = near.join(points, [f"{side}_root", f"{side}_x", f"{side}_y"])
    close = near.withColumn("d", _distance()).where((F.col("d") <= limit) & (F.col("d") > done))
    return close.groupBy("x", "y", F.col("a_island").alias("island")).agg(F.min(_edge()).alias("e"))


#: Edges of an island, and categories of their groups, that one task takes one by one.
FEW_EDGES = 500_000

#: Close pairs of a node that the first distance asks for, about.
FEW_PAIRS = 4


def _one_by_one(edges: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """(gone, root): what is left to merge, by ascending distance and positions."""
    kinds = {root: set(own) for root, own in zip(groups["root"], groups["kinds"])}
    root = {g: g for g in kinds}

    def top(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    for x, y in edges.sort_values(["d", "a", "b"])[["x", "y"]].itertuples(index=False):
        x, y = sorted((top(x), top(y)))
        if x != y and kinds[x].isdisjoint(kinds[y]):
            root[y] = x
            kinds[x] |= kinds[y]
    gone = [g for g in root if top(g) != g]
    return pd.DataFrame({"gone": pd.Series(gone, dtype="int64"), "root": pd.Series([top(g) for g in gone], dtype="int64")})


def _apart(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Of edges (x, y) those between groups (root, kinds) that share no category."""
    columns = edges.columns
    for end in ("x", "y"):
        edges = edges.join(groups.select(F.col("root").alias(end), F.col("kinds").alias(f"of_{end}")), end)
    return edges.where(~F.arrays_overlap("of_x", "of_y")).select(*columns)


def _linked(groups: DataFrame, edges: DataFrame, most_rounds: int) -> DataFrame | None:
    """(node, root) of the groups that were merged into another: single linkage by ascending distance without equal categories.

    Each round merges the pairs of groups whose shortest edge is the shortest of both: no edge that comes before it touches
    either, so taking edges one by one would find the two groups as they are now. Groups that share a category can never
    merge, so their edges are dropped at once, and of several edges between two groups the shortest decides. A group holds
    a category once, so its list of categories is as long as there are categories at most. Once no island has more than
    FEW_EDGES left, which a long chain of ascending distances would spread over many rounds, one task each takes them one by one.
    """
    found: DataFrame | None = None
    for n in range(most_rounds):
        of_edges = groups.join(edges.select(F.explode(F.array("x", "y")).alias("root")).distinct(), "root", "left_semi")
        sizes = edges.select("island", F.lit(1).alias("n")).unionAll(of_edges.select("island", F.size("kinds").alias("n")))
        if (sizes.groupBy("island").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) <= FEW_EDGES:
            rest = edges.select("x", "y", "e.d", "e.a", "e.b", "island").groupBy("island").cogroup(of_edges.groupBy("island"))
            return _moved(found, stored(rest.applyInPandas(_one_by_one, "gone long, root long"), "moves"))
        ends = edges.select(F.col("x").alias("g"), "e").unionAll(edges.select(F.col("y").alias("g"), "e"))
        first = ends.groupBy("g").agg(F.min("e").alias("e"))
        # an edge that is the first of both its groups comes twice
        both = first.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("root"), F.max("g").alias("gone")).where("n = 2")
        moves = stored(both.select("gone", "root"), "moves")
        if moves.isEmpty():
            return found
        found = _moved(found, moves)
        if n % 5 == 4:
            found = stored(found, "roots")
        joined = groups.join(moves, groups["root"] == moves["gone"], "left").select(F.coalesce(moves["root"], groups["root"]).alias("root"), "island", "kinds")
        groups = stored(joined.groupBy("root", "island").agg(F.flatten(F.collect_list("kinds")).alias("kinds")), "groups")
        for end in ("x", "y"):
            edges = edges.join(moves.select(F.col("gone").alias(end), F.col("root").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = edges.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "island").agg(F.min("e").alias("e"))
        edges = stored(_apart(edges, groups), "links")
    raise RuntimeError("the linkage did not settle")


def _distances(nodes: DataFrame, limit: float) -> list[float]:
    """Ascending distances up to ``limit``, each twice the one before; the first has about FEW_PAIRS pairs a node."""
    side = limit if limit > 0 else 1.0
    cells = nodes.groupBy("_island", F.floor(F.col("_t") / side), F.floor(F.col("_m") / side)).agg(F.count(F.lit(1)).cast("double").alias("n"))
    n, squares = cells.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    steps = math.ceil(math.log(1.5 * squares / n / FEW_PAIRS, 4)) if n and limit > 0 else 0
    return [limit / 2**k for k in range(max(steps, 0), -1, -1)]


def _roots(nodes: DataFrame, limit: float, most_rounds: int) -> DataFrame | None:
    """(node, root) of the nodes that hang on another one.

    Distances are taken in steps. All edges of a step come before those of the next, and groups that an edge has left apart
    share a category, so they stay apart: a step only asks for edges longer than those before, between groups as they are,
    and of many between two groups keeps one. So of the pairs of a dense island, which grow with its square, few are kept.
    """
    found: DataFrame | None = None
    done = None
    for reach in _distances(nodes, limit):
        rooted = nodes.withColumn("_root", F.col("_node"))
        if found is not None:
            rooted = stored(nodes.join(found, F.col("_node") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_node")).drop("node", "root"), "rooted")
        groups = stored(rooted.groupBy(F.col("_root").alias("root"), F.col("_island").alias("island")).agg(F.collect_list("_c").alias("kinds")), "groups")
        edges = stored(_close_pairs(nodes, reach) if done is None else _close_groups(rooted, groups, done, reach), "links")
        merged = _linked(groups, edges, most_rounds)
        if merged is not None:
            found = stored(_moved(found, merged.select(F.col("node").alias("gone"), "root")), "roots")
        done = reach
    return found


def _moved(found: DataFrame | None, moves: DataFrame) -> DataFrame:
    """(node, root) after further moves, which apply to the roots so far."""
    new = moves.select(F.col("gone").alias("node"), "root")
    if found is None:
        return new
    later = moves.select(F.col("gone").alias("was"), F.col("root").alias("now"))
    return found.join(later, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root")).unionAll(new)


def group_by_proximity(table: DataFrame, time: str, mass: str, category: str, limit: float, by: list[str], order: list[str], into: str = "linkage", most_rounds: int = 10_000) -> DataFrame:
    """Numbers of proximity groups in each group of ``by``: single linkage by ascending distance up to ``limit``, where no group may hold a category twice.

    Ties: by positions, which follow ``order``; a group's number is its first position. Groups of ``by`` may be of any size:
    close pairs come from cells in steps of distance, and merges are made in rounds. Rows without time or mass stay alone; rows without a
    category count as of one category.
    """
    numbers = stored(numbered(table, [], [*by, *order], "_node"), "nodes")
    first = numbers.groupBy(*by).agg(F.min("_node").alias("_first"))
    placed = null_safe_join(numbers, first, by).withColumn(into, F.col("_node") - F.col("_first"))
    named = placed.select("_node", F.col("_first").alias("_island"), F.col(time).cast("double").alias("_t"), F.col(mass).cast("double").alias("_m"), F.coalesce(F.col(category).cast("string"), F.lit("")).alias("_name")).where(F.col("_t").isNotNull() & F.col("_m").isNotNull())
    placed = placed.drop("_first")
    # a category is known by its first node
    kinds = named.groupBy("_name").agg(F.min("_node").alias("_c"))
    nodes = stored(named.join(kinds, "_name").drop("_name"), "points")
    roots = _roots(nodes, limit, most_rounds)
    if roots is None:
        return placed.drop("_node")
    # the number of a root in its group, brought to all that hang on it
    roots = roots.select("node", F.col("root").alias("_root")).join(placed.select(F.col("_node").alias("_root"), F.col(into).alias("_number")), "_root").select(F.col("node").alias("_node"), "_number")
    return placed.join(roots, "_node", "left").withColumn(into, F.coalesce("_number", into)).drop("_node", "_number")


def cluster_metrics(table: DataFrame, time: str, mass: str, by: list[str], scaling: float = 1.0) -> DataFrame:
    """Means and spreads of groups, and the mean distance of their members from the centre."""
    w = Window.partitionBy(*by)
    d = F.sqrt(F.pow(F.col(time) - F.avg(time).over(w), 2) + F.pow((F.col(mass) - F.avg(mass).over(w)) * scaling, 2))
    return table.withColumn("_d", d).groupBy(*by).agg(
        F.count("*").alias("members"), F.avg(time).alias("mean_time"), F.avg(mass).alias("mean_mass"), (F.max(time) - F.min(time)).alias("time_spread"), (F.max(mass) - F.min(mass)).alias("mass_spread"), F.avg("_d").alias("mean_distance")
    )


def tangled(boxes: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Keys of boxes (tMin, tMax, mMin, mMax) that overlap another one of their group.

    Boxes meet in cells of time as wide as the mean box, so each is in three of them on average; a box is asked about until
    the first that it overlaps.
    """
    width = boxes.agg(F.avg(F.col("tMax") - F.col("tMin")).alias("w")).first()["w"] or 1.0
    boxes = boxes.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("tMin") / width), F.floor(F.col("tMax") / width))))
    other = boxes.select(*by, "_cell", *[F.col(c).alias(f"o_{c}") for c in (key, "tMin", "tMax", "mMin", "mMax")])
    meets = (F.col(key) != F.col(f"o_{key}")) & overlaps(F.col("tMin"), F.col("tMax"), F.col("o_tMin"), F.col("o_tMax")) & overlaps(F.col("mMin"), F.col("mMax"), F.col("o_mMin"), F.col("o_mMax"))
    same = F.col("_cell") == F.col("o__cell")
    for c in by:
        same = same & (F.col(c) == F.col(f"o_{c}"))
    return boxes.join(other.withColumnsRenamed({c: f"o_{c}" for c in (*by, "_cell")}), same & meets, "left_semi").select(key).distinct()


def lfq_groups(features: DataFrame, time_limit: float = 40, mass_limit: float = 10e-6, distance_limit: float | None = None, mass: str = "mz", time: str = "rt", charges: tuple[int, ...] = (1, 2, 3, 4, 5), scaling: float | None = None, require: str | None = "isAnnotated") -> tuple[DataFrame, DataFrame]:
    """Label-free feature groups and their members.

    Features of one charge are split into islands of continuous mass and time; islands with a feature that ``require``
    names are grouped by proximity (log2 mass scaled to seconds), a run at most once in a group. Groups that overlap another
    one of their island are invalid and 'tangled'.
    """
    log_limit = float(np.log2(1 + mass_limit))
    scaling = scaling if scaling is not None else time_limit / log_limit
    distance_limit = distance_limit if distance_limit is not None else time_limit
    own = features.where("isValid").where(F.col("charge").isin(list(charges))).withColumn("logMass", F.log2(mass))
    placed = mass_time_islands(own, "logMass", time, log_limit, time_limit, ["specfile", "id"], ["charge"])
    if require:
        wanted = placed.groupBy("charge", "island").agg(F.bool_or(F.coalesce(F.col(require), F.lit(False))).alias("w")).where("w").drop("w")
        placed = placed.join(wanted, ["charge", "island"], "left_semi")
    scaled = placed.withColumn("_m", F.col("logMass") * scaling)
    linked = group_by_proximity(scaled, time, "_m", "specfile", distance_limit, ["charge", "island"], ["specfile", "id"]).drop("_m")
    members = linked.withColumn("groupId", F.concat_ws("_", "charge", "island", "linkage"))
    metrics = cluster_metrics(members, time, "logMass", ["groupId"], scaling)
    shape = members.groupBy("groupId", "charge", "island").agg(
        F.min(time).alias("tMin"), F.max(time).alias("tMax"), F.min("logMass").alias("mMin"), F.max("logMass").alias("mMax"), F.bool_or(F.coalesce("isAnnotated", F.lit(False))).alias("isAnnotated")
    )
    bad = tangled(shape, "groupId", ["charge", "island"]).withColumn("_bad", F.lit(True))
    groups = shape.join(metrics, "groupId").join(bad, "groupId", "left")
    groups = groups.withColumns({"isValid": F.col("_bad").isNull(), "clusterType": F.when(F.col("_bad"), "tangled"), "logMass": F.col("mean_mass"), "mz": F.pow(F.lit(2.0), F.col("mean_mass"))}).drop("_bad")
    return groups, members


def intensity_matrix(members: DataFrame, runs: list[str], key: str = "groupId", intensity: str = "intensity") -> DataFrame:
    """One row for each group, one column for each run: its feature's intensity, or NaN."""
    wide = members.groupBy(key).pivot("specfile", runs).agg(F.max(intensity).cast("double"))
    return wide.select(key, *[F.coalesce(F.col(f"`{r}`"), F.lit(float("nan"))).alias(r) for r in runs])


def annotate_groups(members: DataFrame, larger_better: bool, key: str = "groupId") -> DataFrame:
    """The best (score, peptide, sequence) of each group's annotated members."""
    entry = F.struct("score", "peptide", "sequence")
    return members.where("isAnnotated").groupBy(key).agg((F.max(entry) if larger_better else F.min(entry)).alias("b")).select(key, "b.*")


__all__ = ["annotate_features", "annotate_groups", "best_annotations", "best_of", "calibrate_rt", "cluster_metrics", "deviations", "group_by_proximity", "intensity_matrix", "lfq_groups", "match_features", "match_statistics", "relative_mass_to_log2", "tangled"]
