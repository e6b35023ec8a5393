"""Keys, foreign keys, discovery and the graph against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tablescope.operators import (catalog as cat, discovery as disc, graph, profile as prof,
                                  relationships as rel)
from tablescope.operators.relationships import (ForeignKey, cardinality, check_fks, failed_fks,
                                                fk_integrity, join_coverage, orphans,
                                                relationship_stats, table_integrity)

from .conftest import rows


def test_hot_key_and_null_parent(spark):
    # one key owns a third of the child rows; NULL among the parents hides nothing
    child = spark.createDataFrame([(1,)] * 400 + [(i,) for i in range(2, 802)] + [(None,)] * 5,
                                  "k int")
    parent = spark.createDataFrame([(i,) for i in range(1, 702)] + [(None,)], "id bigint")
    fk = ForeignKey("c", "k", "p", "id")
    got = relationship_stats({"c": child, "p": parent}, [fk]).first()
    assert (got["child_rows"], got["total_fk_values"], got["orphaned_count"]) == (1205, 1200, 100)
    assert (got["child_max_freq"], got["parent_rows"], got["parent_distinct"]) == (400, 702, 701)
    assert orphans(child, "k", parent, "id").count() == 100


def test_cardinality_kinds(spark):
    tables = {
        "ids": spark.createDataFrame([(1,), (2,), (3,)], "id int"),
        "twice": spark.createDataFrame([(1,), (1,), (2,)], "id int"),
        "unique": spark.createDataFrame([(1,), (2,)], "id int"),
        "holed": spark.createDataFrame([(1,), (None,)], "id int"),
        "none": spark.createDataFrame([], "id int"),
    }
    fks = [ForeignKey(c, "id", p, "id") for c, p in (
        ("unique", "ids"), ("twice", "ids"), ("twice", "twice"), ("holed", "ids"),
        ("none", "ids"), ("ids", "none"), ("none", "none"))]
    got = {(r["child_table"], r["parent_table"]): r["cardinality"]
           for r in cardinality(relationship_stats(tables, fks)).collect()}
    assert got == {("unique", "ids"): "one-to-one", ("twice", "ids"): "one-to-many",
                   ("twice", "twice"): "many-to-many", ("holed", "ids"): "one-to-many",
                   ("none", "ids"): "one-to-many", ("ids", "none"): "one-to-many",
                   ("none", "none"): "one-to-many"}


def test_integrity_defaults_and_mixed_key_types(spark):
    tables = {"c": spark.createDataFrame([(1.0, "a"), (2.5, "z")], "x double, s string"),
              "p": spark.createDataFrame([(1, "a")], "x bigint, s string"),
              "e": spark.createDataFrame([], "x int")}
    report = fk_integrity(tables, [ForeignKey("c", "x", "p", "x"), ForeignKey("c", "s", "p", "s"),
                                   ForeignKey("e", "x", "p", "x")])
    got = {(r["child_table"], r["child_column"]): r["integrity_pct"] for r in report.collect()}
    assert got == {("c", "x"): 50.0, ("c", "s"): 50.0, ("e", "x"): 100.0}
    assert rows(table_integrity(report, prof.row_counts(tables))) == [
        ("c", 50.0), ("e", 100.0), ("p", 100.0)]
    coverage = join_coverage(relationship_stats(tables, [ForeignKey("c", "s", "p", "s")])).first()
    assert (coverage["child_only"], coverage["parent_only"]) == (1, 0)


def test_proposals_are_proven_or_refuted(spark):
    tables = {"c": spark.createDataFrame([(1, None), (2, None)], "a int, gone int"),
              "p": spark.createDataFrame([(1,), (2,)], "id int"),
              "q": spark.createDataFrame([(1,)], "id int")}
    checked = check_fks(relationship_stats(tables, [
        ForeignKey("c", "a", "p", "id"), ForeignKey("c", "a", "q", "id"),
        ForeignKey("c", "gone", "p", "id")]))
    assert rows(checked.select("parent_table", "valid")) == [("p", True), ("q", False)]
    assert failed_fks(checked).first()["error"] == "1 rows without a parent"


def test_inclusions_equal_brute_force_over_many_columns(spark):
    # 70 integer columns need a second mask word
    rng = random.Random(3)
    data, tables = {}, {}
    for t in range(7):
        columns = [[rng.randint(0, rng.choice((2, 4, 9))) for _ in range(12)] for _ in range(10)]
        columns[0] = [None] * 12
        names = [f"c{i}" for i in range(10)]
        tables[f"t{t}"] = spark.createDataFrame(list(zip(*columns)), ", ".join(
            f"{n} int" for n in names))
        data |= {(f"t{t}", n): {v for v in c if v is not None} for n, c in zip(names, columns)}
    expected = {(*a, *b) for a, b in itertools.permutations(data, 2)
                if data[a] and data[a] <= data[b]}
    got = {tuple(r)[:4] for r in disc.inclusions(tables).drop("family").collect()}
    assert got == expected


def test_discovery_ranks_the_named_parent_first(spark):
    tables = {"orders": spark.createDataFrame([(10, 1), (11, 2)], "order_id int, customer_id int"),
              "customer": spark.createDataFrame([(1,), (2,), (3,)], "customer_id int"),
              "numbers": spark.createDataFrame([(i,) for i in range(20)], "n int")}
    keys = disc.candidate_keys(prof.column_profile(tables))
    best = disc.discover_fks(tables, keys).where("rank = 1 and child_column = 'customer_id'")
    assert best.where("child_table = 'orders'").first()["parent_table"] == "customer"


def test_composite_keys(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 1), (2, 1, 2)], "a int, b int, c int")
    got = {r["columns"]: r["is_key"] for r in disc.composite_keys(
        {"t": df}, {"t": [("a", "b"), ("a", "c")]}).collect()}
    assert got == {"a,b": True, "a,c": False}  # a key holds no null


# --- graph ---------------------------------------------------------------------------

def graph_frames(spark, nodes, edges):
    return (spark.createDataFrame([(n,) for n in nodes], "node string"),
            spark.createDataFrame(list(edges), "src string, dst string"))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(22)}
    home = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            home[a] = home[b] = min(home[a], home[b])
    got = dict(rows(graph.connected_components(*graph_frames(spark, nodes, edges))))
    assert got == home


def test_components_of_a_long_path(spark):
    nodes = [f"n{i:03}" for i in range(60)]
    edges = list(zip(nodes, nodes[1:]))
    got = dict(rows(graph.connected_components(*graph_frames(spark, nodes, edges))))
    assert set(got.values()) == {"n000"}


def brute_betweenness(nodes, edges):
    near = {n: set() for n in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def shortest(a, b):
        paths = [[a]]
        while paths:
            done = [p for p in paths if p[-1] == b]
            if done:
                return done
            paths = [[*p, x] for p in paths for x in near[p[-1]] if x not in p]
        return []

    score = dict.fromkeys(nodes, 0.0)
    for a, b in itertools.permutations(nodes, 2):
        paths = shortest(a, b)
        for p in paths:
            for n in p[1:-1]:
                score[n] += 1 / len(paths)
    scale = (len(nodes) - 1) * (len(nodes) - 2)
    return {n: s / scale for n, s in score.items()}


def test_betweenness_equals_brute_force(spark):
    rng = random.Random(5)
    nodes = [f"n{i}" for i in range(8)]
    edges = {(nodes[i], nodes[rng.randrange(i)]) for i in range(1, 8)}
    edges |= {(rng.choice(nodes), rng.choice(nodes)) for _ in range(4)}
    got = dict(rows(graph.betweenness(*graph_frames(spark, nodes, edges))))
    assert got == {n: pytest.approx(v) for n, v in brute_betweenness(nodes, edges).items()}


def test_degree_of_loops_and_parallel_edges(spark):
    nodes, edges = graph_frames(spark, ["a", "b", "c"], [("a", "a"), ("a", "b"), ("b", "a")])
    assert rows(graph.degree_centrality(nodes, edges)) == [("a", 3, 1.5), ("b", 1, 0.5),
                                                           ("c", 0, 0.0)]
    assert rows(graph.isolated(nodes, edges)) == [("c",)]
    metrics = graph.graph_metrics(nodes, edges).first()
    assert (metrics["connected_components"], metrics["hub_table"]) == (2, "a")


# --- catalog ---------------------------------------------------------------------------

def small_catalog(spark):
    tables = {
        "zoo": spark.createDataFrame([(1, 1)], "zoo_id int, keeper_id int"),
        "keeper_list": spark.createDataFrame([(1, 1)], "keeper_id int, boss_id int"),
        "visit": spark.createDataFrame([(1, 1)], "zoo_id int, keeper_id int"),
        "alone": spark.createDataFrame([], "id int, Name string"),
    }
    fks = spark.createDataFrame([
        ("visit", "zoo_id", "zoo", "zoo_id", False),
        ("visit", "keeper_id", "keeper_list", "keeper_id", False),
        ("keeper_list", "boss_id", "keeper_list", "keeper_id", True)],
        "child_table string, child_column string, parent_table string, parent_column string, "
        "inferred boolean")
    keys = spark.createDataFrame([("zoo", "zoo_id"), ("visit", "zoo_id"), ("visit", "keeper_id")],
                                 "table string, column string")
    return tables, cat.extract_catalog(tables, keys, fks)


def test_roles_and_weak_entities(spark):
    _, catalog = small_catalog(spark)
    assert {r["table"]: r["role"] for r in cat.table_roles(catalog).collect()} == {
        "zoo": "dimension", "keeper_list": "dimension", "visit": "junction", "alone": "isolated"}
    assert {r["table"]: r["role"] for r in cat.table_roles(catalog, "app").collect()} == {
        "zoo": "dimension", "keeper_list": "dimension", "visit": "fact", "alone": "isolated"}
    assert rows(cat.weak_entities(catalog)) == [("visit", 2)]


def test_a_self_reference_is_no_reference_by_others(spark):
    tables = {"t": spark.createDataFrame([(1, 1)], "id int, up_id int")}
    fks = spark.createDataFrame([("t", "up_id", "t", "id", False)],
                                "child_table string, child_column string, parent_table string, "
                                "parent_column string, inferred boolean")
    keys = spark.createDataFrame([("t", "id")], "table string, column string")
    role = cat.table_roles(cat.extract_catalog(tables, keys, fks)).first()
    assert (role["role"], role["fks_out"], role["referenced"]) == ("dimension", 1, False)


def test_names_give_foreign_keys(spark):
    tables, catalog = small_catalog(spark)
    found = cat.infer_fks_by_name(catalog.columns, catalog.tables)
    assert {tuple(r)[:3] for r in found.collect()} == {
        ("visit", "zoo_id", "zoo"), ("zoo", "keeper_id", "keeper_list"),
        ("visit", "keeper_id", "keeper_list")}
    assert cat.merge_fks(catalog.fks, found).count() == 4


def test_anomaly_codes(spark):
    tables, catalog = small_catalog(spark)
    found = cat.anomalies(catalog, prof.null_profile(tables))
    codes = {(r["code"], r["table"], r["column"]) for r in found.collect()}
    assert {("EMPTY_TABLE", "alone", None), ("NO_PRIMARY_KEY", "keeper_list", None),
            ("AMBIGUOUS_NAME", "alone", "Name"), ("ORPHAN_FK_COLUMN", "zoo", "keeper_id")} <= codes
    assert not any(c == "ALL_NULL_COLUMN" for c, *_ in codes)


def test_duplicate_names_ignore_case(spark):
    columns = spark.createDataFrame(
        [("t", 1, "A", "int", True, True, False, None), ("t", 2, "a", "int", True, False, False,
                                                         None)], cat.COLUMN_SCHEMA)
    tables = spark.createDataFrame([("t", 1, 5, 2)], "table string, position int, row_count bigint, "
                                                     "column_count int")
    fks = spark.createDataFrame([], "child_table string, child_column string, parent_table string, "
                                    "parent_column string, inferred boolean")
    profile = spark.createDataFrame([], "table string, column string, row_count bigint, "
                                        "null_count bigint")
    found = cat.anomalies(cat.Catalog(tables, columns, fks), profile)
    assert rows(found.select("code", "column")) == [("DUPLICATE_COLUMN", "a")]


@pytest.mark.parametrize("approx", [False, True])
def test_profiles_of_columns_with_equal_names(spark, approx):
    df = spark.createDataFrame([(1, "x", None, 2.0, [1]), (2, "x", "y", float("nan"), None)],
                               "p int, q string, r string, s double, t array<int>").toDF("a", "A", "a", "b.`c", "a")
    tables = {"t": df, "u": df.where("false")}
    want = [("t", 1, "a", 2, 0), ("t", 2, "A", 2, 0), ("t", 3, "a", 2, 1), ("t", 4, "b.`c", 2, 1), ("t", 5, "a", 2, 1)]
    want += [("u", i, c, 0, 0) for _, i, c, _, _ in want]
    names = ["table", "ordinal", "column", "row_count", "null_count"]
    assert rows(prof.null_profile(tables).select(*names)) == sorted(want, key=repr)
    profile = prof.column_profile(tables, approx)
    assert rows(profile.select(*names)) == sorted(want, key=repr)
    assert rows(profile.where("table = 't'").select("ordinal", "distinct_count")) == [
        (1, 2), (2, 1), (3, 1), (4, 1), (5, None)]
    keys = disc.candidate_keys(profile)
    fks = rel.fk_relation(spark, [])
    catalog = cat.extract_catalog(tables, disc.propose_primary_keys(keys), fks, keys, profile)
    assert catalog.columns.count() == 10
    assert rows(catalog.columns.where("table = 't'").select("ordinal", "nullable")) == [
        (1, False), (2, False), (3, True), (4, True), (5, True)]
    found = cat.anomalies(catalog, profile).where("code = 'DUPLICATE_COLUMN'")
    assert rows(found.select("table", "column")) == [(t, c) for t in "tu" for c in ("A", "a", "a")]
    samples = cat.column_dictionary(catalog, tables, {"t": ["b.`c"], "u": ["B.`C"]})
    assert rows(samples.where("table = 't'").select("ordinal", "samples")) == [
        (1, "1 | 2"), (2, "x | x"), (3, "y"), (4, "2.0 | NaN"), (5, "[1]")]


def test_er_edges_labels(spark):
    _, catalog = small_catalog(spark)
    edges = cat.er_edges(cat.relationships(catalog.fks))
    assert ("visit", "zoo", "zoo_id", "||--o{", "Zoo") in rows(edges)
