"""The stored catalog and profiles that merge by part."""

import datetime

import pytest

from tablescope.operators import catalog as cat, discovery as disc, profile as prof, relationships as rel
from tablescope.sources import sqltext, store

from .conftest import rows
from .test_plans import below, plan_nodes


def measured(tables, spark):
    profile = prof.column_profile(tables)
    keys = disc.candidate_keys(profile)
    return cat.extract_catalog(tables, disc.propose_primary_keys(keys), rel.fk_relation(spark, []), keys,
                               profile), profile


def test_consumers_read_the_store_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    tables = {"part": spark.read.parquet("/root/testdata/sf0.001/part.parquet")}
    assert store.manifest(spark, path).count() == 0 and store.load_catalog(spark, path) is None
    built = []

    def build():
        built.append(1)
        return measured(tables, spark)

    found = store.stored_catalog(spark, path, "monday", build)
    again = store.stored_catalog(spark, path, "monday", build)
    assert built == [1] and found.version == again.version
    direct, profile = measured(tables, spark)
    assert rows(again.catalog.columns) == rows(direct.columns) and rows(again.profile) == rows(profile)
    ddl = sqltext.table_ddl(again.catalog, "mysql")
    assert rows(ddl) == rows(sqltext.table_ddl(direct, "mysql"))
    assert not any("sf0.001" in node.toString() for _, name, node in plan_nodes(ddl) if name.startswith("Scan"))


def test_versions_by_key_and_half_written_ones(spark, tmp_path):
    path = str(tmp_path / "store")
    first, second = ({"t": spark.range(n)} for n in (3, 5))
    one = store.save_catalog(*measured(first, spark), path, "a")
    two = store.save_catalog(*measured(second, spark), path, "b")
    # a version whose writer died before the manifest is never seen
    spark.range(1).write.parquet(f"{path}/versions/dead/tables")
    assert store.load_catalog(spark, path).version == two
    assert store.load_catalog(spark, path, "a").version == one
    assert store.load_catalog(spark, path, "c") is None
    assert store.load_catalog(spark, path, "a").catalog.tables.first()["row_count"] == 3
    assert rows(store.manifest(spark, path).select("key", "tables", "columns")) == [("a", 1, 1), ("b", 1, 1)]


@pytest.fixture
def loads(spark):
    df = spark.range(0, 3000, 1, 5).selectExpr(
        "id", "if(id % 5 = 0, NULL, concat('v', id % 700)) AS t", "if(id % 3 = 0, double('NaN'), id % 50) AS x",
        "array(id) AS nested", "date_add(date'2024-01-01', int(id % 40)) AS day", "cast(NULL AS string) AS gone",
        "if(id % 2 = 0, -0.0D, 0.0D) AS zero", "decimal(id % 9) / 4 AS d")
    return {"t": df}


def test_parts_merge_to_the_profile_of_all_rows(spark, tmp_path, loads):
    path = str(tmp_path / "parts")
    for part in range(4):
        store.write_profile_part({"t": loads["t"].where(f"id % 4 = {part}")}, path, f"p{part}")
    # a part written again counts once, whatever stood there before
    store.write_profile_part({"t": loads["t"].where("id % 4 = 1 OR id < 100")}, path, "p1")
    store.write_profile_part({"t": loads["t"].where("id % 4 = 1")}, path, "p1")
    merged = {r["column"]: r for r in store.read_profile(spark, path).collect()}
    whole = {r["column"]: r for r in prof.column_profile(loads).collect()}
    assert merged.keys() == whole.keys()
    for c, r in whole.items():
        m = merged[c]
        for name in ("table", "ordinal", "type", "row_count", "null_count", "null_pct", "status", "flag"):
            assert m[name] == r[name], (c, name)
        if r["distinct_count"] is None:
            assert m["distinct_count"] is None
        else:
            assert abs(m["distinct_count"] - r["distinct_count"]) <= 0.025 * r["distinct_count"], c


def test_empty_parts_equal_names_and_new_schemas(spark, tmp_path):
    path = str(tmp_path / "parts")
    twins = spark.createDataFrame([(1, "x"), (2, None)], "p int, q string").toDF("a", "A")
    store.write_profile_part({"t": twins, "none": twins.where("false")}, path, "2024-01-01")
    store.write_profile_part({"t": twins.where("false")}, path, "2024-01-02")
    found = store.read_profile(spark, path).select("table", "ordinal", "column", "row_count", "null_count", "distinct_count")
    assert rows(found) == [("none", 1, "a", 0, 0, 0), ("none", 2, "A", 0, 0, 0), ("t", 1, "a", 2, 0, 2), ("t", 2, "A", 2, 1, 1)]
    store.write_profile_part({"t": spark.createDataFrame([(datetime.date(2024, 1, 1),)], "a date")}, path, "2024-01-03")
    assert rows(store.read_profile(spark, path).where("`table` = 't' AND ordinal = 1").select("type", "row_count")) == [
        ("date", 1), ("int", 2)]


def test_states_carry_no_values(loads):
    state = store.profile_state(loads)
    # partial and final aggregate without groups: one row of counters and sketches per task
    under = below(state, "ObjectHashAggregate")
    assert "ObjectHashAggregate" in under and not {"Generate", "Expand"} & set(under)
