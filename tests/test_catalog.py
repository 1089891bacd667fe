import duckdb
import pytest

import __spark_entry__ as entry
from spectrel.plans.catalog import QUERIES, SQL
from test_operators import greedily_redundant, plain_classes, plain_groups, plain_linkage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    one = lambda v: None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == plain(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())


@pytest.fixture(scope="module")
def lines():
    """Orders as proteins and their peptides, as the inference queries have them."""
    graph: dict = {}
    for order, part in duckdb.sql(f"select l_orderkey, l_partkey from '{SF}/lineitem.parquet'").fetchall():
        graph.setdefault(order, set()).add(order // 32 * 24 + part % 24)
    return graph


def test_redundant_query(spark, lines):
    want = greedily_redundant(lines)
    assert want and sorted(r["protein"] for r in QUERIES["redundant"](spark, SF).collect()) == sorted(want)


def test_group_queries(spark, lines):
    want, _ = plain_groups(lines)
    got = [(r["group"], r["protein"], r["role"]) for r in QUERIES["protein_groups"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    classes = [tuple(r) for r in QUERIES["peptide_classes"](spark, SF).select("peptide", "class").collect()]
    assert dict(classes) == plain_classes(lines, want) and len(classes) == len(dict(classes))


def test_peptide_leaders_query(spark, lines):
    want, _ = plain_groups(lines)
    leading, groups_of = {}, {}
    for group, protein, role in want:
        groups_of.setdefault(protein, set()).add(group)
        if role == "leading":
            leading.setdefault(group, set()).add(protein)
    found: dict = {}
    for protein, peptides in lines.items():
        for peptide in peptides:
            found.setdefault(peptide, set()).update(g for g in groups_of.get(protein, ()) if g in leading)
    names = lambda group: ";".join(sorted(map(str, leading[group])))
    got = [tuple(r) for r in QUERIES["peptide_leaders"](spark, SF).select("peptide", "leaders", "n_groups").collect()]
    expected = {p: {names(g) for g in groups} for p, groups in found.items() if groups}
    assert sorted(got) == sorted((p, " | ".join(sorted(own)), len(own)) for p, own in expected.items())


def test_proximity_query(spark, duck):
    rows: dict = {}
    for event, kind, island in duck.execute(SQL["continuity"]).fetchall():
        rows[event] = (kind, island)
    groups: dict = {}
    for event, user, value, t in duck.execute("select event_id, user_id, value, epoch_us(ts) / 1e6 as t from events order by t, event_id").fetchall():
        groups.setdefault(rows[event], []).append((event, (t, value * 1000, user)))
    want = {event: (*key, n) for key, own in groups.items() for (event, _), n in zip(own, plain_linkage([x for _, x in own], 30000.0))}
    got = QUERIES["proximity"](spark, SF).collect()
    assert len(got) == len(want) and {r["id"]: (r["event_type"], r["island"], r["linkage"]) for r in got} == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"redundant", "protein_groups", "peptide_classes", "peptide_leaders", "proximity"}))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming(spark, tmp_path):
    from spectrel.streaming import runs

    rows = [(1, f"2024-01-01 00:{m:02}:00", float(m)) for m in (0, 5, 30, 31)] + [(1, "2024-01-02 00:00:00", 1.0), (1, "2024-01-03 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, value double").selectExpr("user_id", "cast(ts as timestamp) ts", "value")
    for i, part in enumerate((df.where("day(ts) = 1"), df.where("day(ts) > 1"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = runs.activity_islands(runs.stream(spark, str(tmp_path / "in"), "user_id long, ts timestamp, value double"), "ts", ["user_id"])
        runs.run_to_end(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((str(r["start"]), r["n"], r["mean_value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [("2024-01-01 00:00:00", 2, 2.5), ("2024-01-01 00:30:00", 2, 30.5)]


def test_sliding_means_of_a_stream(spark, tmp_path):
    from spectrel.streaming import runs

    minutes = [0, 3, 4, 7, 12]
    rows = [(1, f"2024-01-01 00:{m:02}:00", float(m)) for m in minutes] + [(1, "2024-01-02 00:00:00", 1.0), (1, "2024-01-03 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, value double").selectExpr("user_id", "cast(ts as timestamp) ts", "value")
    for part in (df.where("day(ts) = 1"), df.where("day(ts) > 1")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = runs.sliding_mean(runs.stream(spark, str(tmp_path / "in"), "user_id long, ts timestamp, value double"), "ts", ["user_id"])
        runs.run_to_end(out, str(tmp_path / "out"), str(tmp_path / "state"))
    want = {}
    for start in range(-5, 15, 5):
        inside = [m for m in minutes if start <= m < start + 10]
        want[start] = (len(inside), sum(inside) / len(inside))
    got = spark.read.parquet(str(tmp_path / "out")).where("end < '2024-01-01 12:00:00'").selectExpr("cast((unix_timestamp(start) - unix_timestamp(timestamp '2024-01-01 00:00:00')) / 60 as int) m", "n", "mean_value").collect()
    assert {r["m"]: (r["n"], r["mean_value"]) for r in got} == {m: (n, pytest.approx(v)) for m, (n, v) in want.items()} and len(got) == len(want)
