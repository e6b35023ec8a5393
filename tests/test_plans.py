"""What the plans do: what is shuffled, how rows are multiplied, how often a table is read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators import catalog as cat, discovery as disc, profile as prof, relationships as rel, stats
from tablescope.plans import scorecard as cards

from .conftest import rows


def plan_nodes(df):
    """(depth, name, node) of the physical plan, from the top."""
    def walk(node, depth):
        name = node.nodeName()
        yield depth, name, node
        if name == "AdaptiveSparkPlan":
            yield from walk(node.inputPlan(), depth + 1)
            return
        children = node.children()
        for i in range(children.size()):
            yield from walk(children.apply(i), depth + 1)
    return list(walk(df._jdf.queryExecution().executedPlan(), 0))


def below(df, name):
    """Names of the nodes under the first node whose name begins like that."""
    found, limit = None, None
    for depth, one, _ in plan_nodes(df):
        if limit is not None:
            if depth <= limit:
                break
            found.append(one)
        elif one.startswith(name):
            found, limit = [], depth
    return found


def exchanged_text(df):
    """Names of text columns in exchanges."""
    names = set()
    for _, name, node in plan_nodes(df):
        if name == "Exchange":
            out = node.output()
            names |= {out.apply(i).name() for i in range(out.size()) if out.apply(i).dataType().typeName() == "string"}
    return names


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    body = "https://example.org/some/long/common/start/"
    values = [rng.choice([None, "", "ab", "short", body + "x" * rng.randint(1, 3), body + str(rng.randint(0, 9)),
                          "é" * rng.randint(14, 17)]) for _ in range(600)]
    return spark.createDataFrame([(v, f"{i % 200}" if i % 2 else None) for i, v in enumerate(values)], "t string, u string")


def test_texts_are_counted_by_digest(texts):
    counts = prof.text_counts(texts, ["t", "u"])
    assert exchanged_text(counts) <= {"column"}
    widest = counts.agg(F.max(F.octet_length("digest") + F.octet_length("head"))).first()[0]
    assert widest <= prof.HEAD_BYTES + 32


@pytest.mark.parametrize("collected", [10_000, 1])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_winners_equal_counting_all(monkeypatch, texts, collected, k):
    monkeypatch.setattr(prof, "COLLECTED_WINNERS", collected)
    plain = texts.unpivot([], ["t", "u"], "column", "value").groupBy("column", "value").count().collect()
    for which, sign in (("most", -1), ("least", 1)):
        expected = []
        for c in ("t", "u"):
            order = sorted((sign * r["count"], r["value"] is not None, (r["value"] or "").encode()) for r in plain if r["column"] == c)
            expected += [(c, i, v.decode() if some else None, abs(n)) for i, (n, some, v) in enumerate(order[:k], 1)]
        found = prof.text_winners(texts, ["t", "u"], k, (which,)).select("column", "rank", "value", "n")
        assert rows(found) == sorted(expected, key=repr)


def test_only_winning_bodies_travel(texts):
    """Beyond the driver's winners, a body leaves its task only as one of a winner."""
    found = prof.column_modes(texts)
    assert exchanged_text(found) <= {"column", "which", "text", "value", "mode"}
    short = prof.column_modes(texts.select("u"))
    assert not exchanged_text(short) - {"column", "which"}


def test_outliers_are_counted_without_a_row_per_cell(spark):
    df = spark.range(200).selectExpr("double(id) AS a", "double(id * id) AS b", "if(id % 7 = 0, NULL, id) AS c")
    under = below(stats.outlier_counts({"t": df}), "HashAggregate")
    assert under and not {"Generate", "Expand"} & set(under) and not any("Join" in n for n in under)
    under = below(stats.box_plot(df), "HashAggregate")
    assert under and not {"Generate", "Expand"} & set(under) and not any("Join" in n for n in under)


def test_scorecard_reads_a_table_once_for_all_measures(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    card = cards.scorecard6({"lineitem": df}, {}, [], "2002-01-01 00:00:00")
    assert sum(name.startswith("Scan parquet") for _, name, _ in plan_nodes(card)) == 1


def test_correlation_emits_no_row_per_pair_and_row(spark):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((300, 60)) @ rng.standard_normal((60, 60)) + 1e6
    hole = rng.random((300, 60)) < 0.1
    table = [tuple(None if h else float(v) for v, h in zip(r, g)) for r, g in zip(data, hole)]
    df = spark.createDataFrame(table, ", ".join(f"c{i} double" for i in range(60))).repartition(4)
    matrix = stats.correlation_matrix(df)
    under = below(matrix, "MapInArrow")
    assert under and not {"Generate", "Expand"} & set(under)
    found = {(r[0], r[1]): r[2] for r in matrix.collect()}
    assert len(found) == 3600
    for a in range(0, 60, 7):
        for b in range(60):
            both = ~hole[:, a] & ~hole[:, b]
            want = 1.0 if a == b else np.corrcoef(data[both, a], data[both, b])[0, 1]
            assert found[f"c{a}", f"c{b}"] == pytest.approx(want, abs=1e-9)


def test_correlation_of_tiles_and_spread_around_large_values(spark, monkeypatch):
    monkeypatch.setattr(stats, "CORRELATION_TILE", 2)
    df = spark.range(0, 1000, 1, 7).selectExpr(
        "1e12 + id % 10 AS a", "double(id % 10) AS b", "double(7) AS flat", "if(id < 1, id, NULL) AS once",
        "if(id % 2 = 0, double(id), NULL) AS even", "if(id % 2 = 1, double(id), NULL) AS odd")
    found = {(r[0], r[1]): r[2] for r in stats.correlation_matrix(df).collect()}
    assert len(found) == 36 and found["a", "b"] == pytest.approx(1.0, abs=1e-9) == found["b", "a"]
    assert found["flat", "flat"] is None and found["flat", "a"] is None and found["even", "odd"] is None
    assert found["once", "once"] is None and found["odd", "odd"] == 1.0


def test_samples_of_sparse_columns_come_from_one_scan(spark, tmp_path):
    path = str(tmp_path / "sparse")
    spark.range(0, 4000, 1, 4).selectExpr("id", *[
        f"if(id % {307 + i} = {i + 20}, concat('v', id), NULL) AS c{i}" for i in range(200)]).write.parquet(path)
    tables = {"t": spark.read.parquet(path)}
    catalog = cat.Catalog(cat.extract_tables(tables), cat.extract_columns(tables), rel.fk_relation(spark, []))
    picked = cat.column_dictionary(catalog, tables, {"t": ["id"]})
    names = [name for _, name, _ in plan_nodes(picked)]
    # two for the samples, one that counts rows for the list of tables
    assert sum(n.startswith("Scan parquet") for n in names) <= 3
    assert names.count("WindowGroupLimit") >= 2
    found = {r["column"]: r["samples"] for r in picked.collect()}
    for i in (0, 3, 101, 199):
        hits = [x for x in range(4000) if x % (307 + i) == i + 20][:3]
        assert found[f"c{i}"] == " | ".join(f"v{x}" for x in hits)


def test_discovery_shuffles_values_once(spark):
    tables = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("lineitem", "orders", "part")}
    found = disc.discover_fks(tables)
    found.collect()
    scans = [n for n in str(found._jdf.queryExecution().executedPlan().toString()).split("== Initial Plan ==")[0].split("\n")
             if "FileScan parquet" in n and "lineitem.parquet" in n]
    # one for each of integers, texts and dates, one for the counts
    assert 1 <= len(scans) <= 5
    assert rows(found) == rows(disc.discover_fks(tables, disc.candidate_keys(prof.column_profile(tables))))
