"""Protein inference from edges (protein, peptide): clusters, equal and subset proteins, redundant ones, groups and roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .ordered import numbered
from .tables import stored


def clusters(edges: DataFrame) -> DataFrame:
    """(protein, cluster): connected components; a cluster is known by its least protein."""
    own = edges.select("protein", "peptide").distinct()
    first = own.groupBy("peptide").agg(F.min("protein").alias("hub"))
    pairs = own.join(first, "peptide").select(F.col("protein").alias("a"), F.col("hub").alias("b"))
    found = components(pairs)
    return own.select("protein").distinct().join(found, F.col("protein") == F.col("node"), "left").select("protein", F.coalesce("component", "protein").alias("cluster"))


def samesets(edges: DataFrame) -> DataFrame:
    """(representative, members, peptides): proteins of equal peptides, known by the first; single ones too."""
    sets = edges.groupBy("protein").agg(F.array_sort(F.collect_set("peptide")).alias("peptides"))
    return sets.groupBy("peptides").agg(F.array_sort(F.collect_list("protein")).alias("members")).select(F.col("members")[0].alias("representative"), "members", "peptides")


def unique_proteins(edges: DataFrame) -> DataFrame:
    """Proteins with a peptide that no other protein has."""
    return edges.distinct().groupBy("peptide").agg(F.count("*").alias("n"), F.min("protein").alias("protein")).where("n = 1").select("protein").distinct()


def unique_peptides(edges: DataFrame) -> DataFrame:
    return edges.distinct().groupBy("peptide").count().where("count = 1").select("peptide")


#: A bit for each peptide, by its hash.
_BIT = "shiftleft(1L, cast(pmod(xxhash64({}), 64) as int))"


def subsets(edges: DataFrame) -> DataFrame:
    """(protein, superset): proteins whose peptides are a proper part of another's. Only a protein's rarest peptide is looked up."""
    own = edges.select("protein", "peptide").distinct()
    sizes = own.groupBy("protein").agg(F.count("*").alias("n"), F.bit_or(F.expr(_BIT.format("peptide"))).alias("mask"))
    return _subsets(own.join(sizes, "protein"))


def _subsets(own: DataFrame) -> DataFrame:
    """The same of distinct edges with n, the protein's peptides, and their bits in mask: a superset's mask holds them all, then peptides decide."""
    seen = own.join(own.groupBy("peptide").agg(F.count("*").alias("users")), "peptide")
    rarest = seen.groupBy("protein").agg(F.min("users").alias("users"), F.min_by("peptide", "users").alias("peptide"), F.first("n").alias("n"), F.first("mask").alias("mask"))
    # a superset must hold the rarest peptide, so that isn't its protein's alone: candidates are counted on that
    others = own.select("peptide", F.col("protein").alias("superset"), F.col("n").alias("m"), F.col("mask").alias("has"))
    larger = (F.col("protein") != F.col("superset")) & (F.col("m") > F.col("n")) & (F.col("mask").bitwiseAND(F.col("has")) == F.col("mask"))
    candidates = rarest.where("users > 1").join(others, "peptide").where(larger).select("protein", "superset", "n")
    edges = own.select("protein", "peptide")
    shared = candidates.join(edges, "protein").join(edges.withColumnRenamed("protein", "superset"), ["superset", "peptide"], "left_semi").groupBy("protein", "superset").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    return shared.where("c = n").select("protein", "superset")


def redundant_proteins(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Proteins that aren't needed to explain all peptides, by a greedy order: few peptides first, then frequent ones, then names from the end.

    Proteins are taken in that order, and one goes if each of its peptides is still held by another. That is decided for
    many proteins at once, in rounds, with the same outcome: a peptide's *frequency* is the number of proteins that still
    hold it, and it falls by no more than the number of undecided proteins before a protein in the order. So a protein
    with a peptide of frequency 1 stays for certain; and one goes for certain if all its peptides' frequencies would be
    above 1 even if all undecided proteins before it went. The first undecided protein is always one or the other, and
    proteins that share no peptides don't wait for each other. Frequencies are kept in a table, no cluster or peptide is
    ever gathered in one task, and each round writes what it decided.
    """
    return _redundant(stored(edges.select("protein", "peptide").distinct(), "edges"), most_rounds)


def _redundant(own: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """The same of distinct edges, which are read several times."""
    frequency = own.groupBy("peptide").agg(F.count(F.lit(1)).alias("f"))
    # frequencies from the highest, each with how often it occurs: they sort as the full lists do, and stay short
    often = own.join(frequency, "peptide").groupBy("protein", "f").agg(F.count(F.lit(1)).alias("times"))
    seen = F.sort_array(F.collect_list(F.struct((-F.col("f")).alias("f"), (-F.col("times")).alias("times"))))
    candidates = often.groupBy("protein").agg(F.min("f").alias("least"), F.sum("times").alias("n"), seen.alias("seen")).where("least > 1")
    turn = numbered(candidates.select("protein", "n", "seen"), [], ["n", "seen", F.desc("protein")], "turn").select("protein", "turn")
    # a protein's place among its peptide's candidates: proteins before it that are undecided are at most this less the first place that is
    placed = numbered(own.join(turn, "protein").select("protein", "turn", "peptide"), ["peptide"], ["turn"], "place")
    waiting = stored(placed.select("protein", "peptide", "place"), "waiting")
    left = stored(frequency.join(waiting.select("peptide").distinct(), "peptide", "left_semi"), "frequencies")
    gone = []
    for _ in range(most_rounds):
        first = waiting.groupBy("peptide").agg(F.min("place").alias("first")).join(left, "peptide")
        kept = F.col("f") - (F.col("place") - F.col("first"))
        state = waiting.join(first, "peptide").groupBy("protein").agg(F.min("f").alias("least"), F.min(kept).alias("kept"))
        decided = F.when(F.col("least") <= 1, F.lit(False)).when(F.col("kept") > 1, F.lit(True))
        state = stored(state.select("protein", decided.alias("goes")), "round")
        waits, goes = state.agg(F.count_if(F.col("goes").isNull()), F.count_if("goes")).first()
        if goes:
            gone.append(state.where("goes").select("protein"))
        if not waits:
            break
        fewer = waiting.join(state.where("goes").select("protein"), "protein", "left_semi").groupBy("peptide").agg(F.count(F.lit(1)).alias("lost"))
        waiting = stored(waiting.join(state.where("goes is null").select("protein"), "protein", "left_semi"), "waiting")
        if goes:
            left = stored(left.join(fewer, "peptide", "left").select("peptide", (F.col("f") - F.coalesce("lost", F.lit(0))).alias("f")), "frequencies")
    else:
        raise RuntimeError("the greedy order did not settle")
    return reduce(DataFrame.unionAll, gone) if gone else own.select("protein").limit(0)


def protein_groups(edges: DataFrame, with_clusters: bool = True) -> dict[str, DataFrame]:
    """All results of an inference; without clusters only members and peptides, which don't ask for components.

    members: (group, protein, role in leading, subset, subsumable); a group is known by its first leading protein.
    proteins: (protein, cluster, isLeading, isSubset, isSubsumable, isSameset). peptides: (peptide, class in unique,
    groupUnique, groupSubsumable, shared).
    """
    own = stored(edges.select("protein", "peptide").distinct(), "edges")
    same = stored(samesets(own), "samesets")
    mask = F.expr(f"aggregate(peptides, 0L, (a, x) -> a | {_BIT.format('x')})")
    sized = stored(same.select(F.col("representative").alias("protein"), F.explode("peptides").alias("peptide"), F.size("peptides").cast("long").alias("n"), mask.alias("mask")), "merged")
    merged = sized.select("protein", "peptide")
    unique = unique_proteins(merged)
    below = stored(_subsets(sized).join(unique, "protein", "left_anti"), "subsets")
    small = below.select("protein").distinct()
    rest = stored(merged.join(small, "protein", "left_anti"), "rest")
    subsumable = stored(_redundant(rest), "subsumable")
    # a protein of unique peptides has one that no other has, so redundancy never takes it
    leading = stored(rest.select("protein").distinct().join(subsumable, "protein", "left_anti"), "leading")

    lead_of = leading.select("protein", F.col("protein").alias("group"))
    in_groups = below.join(leading.select(F.col("protein").alias("superset")), "superset", "left_semi")
    as_subset = in_groups.select("protein", F.col("superset").alias("group"))
    # redundant proteins join all groups that share a peptide with them
    lead_by_peptide = merged.join(lead_of, "protein").select("peptide", "group")
    direct = merged.join(subsumable, "protein", "left_semi").join(lead_by_peptide, "peptide").select("protein", "group").distinct()
    late = below.join(in_groups.select("protein").distinct(), "protein", "left_anti")
    indirect = late.join(direct.select(F.col("protein").alias("superset"), "group"), "superset").select("protein", "group")
    roles = lead_of.withColumn("role", F.lit("leading")).unionByName(as_subset.withColumn("role", F.lit("subset"))).unionByName(direct.unionByName(indirect).distinct().withColumn("role", F.lit("subsumable")))
    roles = stored(roles, "roles")
    names = same.select(F.col("representative").alias("protein"), F.explode("members").alias("member"))
    members = roles.join(names, "protein").select("group", F.col("member").alias("protein"), "role")

    of_group = merged.join(roles.where("role <> 'subsumable'"), "protein").select("peptide", "group").distinct().groupBy("peptide").agg(F.count("*").alias("groups"))
    from_subsumable = merged.join(roles.where("role = 'subsumable'").select("protein").distinct(), "protein", "left_semi").select("peptide").distinct().withColumn("sub", F.lit(True))
    alone = unique_peptides(merged).withColumn("one", F.lit(True))
    sorted_ = own.select("peptide").distinct().join(of_group, "peptide", "left").join(from_subsumable, "peptide", "left").join(alone, "peptide", "left")
    # classes may overlap: a peptide that only a subsumable protein has would be both unique and groupSubsumable
    kinds = F.when(F.col("groups") > 1, "shared").when(F.col("one"), "unique").when(F.col("sub"), "groupSubsumable").otherwise("groupUnique")
    peptides = sorted_.select("peptide", kinds.alias("class"))

    if not with_clusters:
        return {"members": members, "peptides": peptides}

    cluster = clusters(own)
    flag = lambda df, name: df.select("protein").distinct().withColumn(name, F.lit(True))
    each = names.select("protein", "member").join(flag(leading, "isLeading"), "protein", "left").join(flag(below, "isSubset"), "protein", "left").join(flag(direct.unionByName(indirect), "isSubsumable"), "protein", "left")
    size = same.select(F.col("representative").alias("protein"), (F.size("members") > 1).alias("isSameset"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("isLeading", "isSubset", "isSubsumable")]
    proteins = each.join(size, "protein").select(F.col("member").alias("protein"), *flags, "isSameset").join(cluster, "protein")
    return {"members": members, "proteins": proteins, "peptides": peptides, "clusters": cluster}
