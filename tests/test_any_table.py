"""Operators on tables without a type family, keys of mixed exact types, sparse columns."""

import pytest
from pyspark.sql import functions as F

from tablescope import ForeignKey
from tablescope.functions import exprs
from tablescope.operators import discovery, infer, quality, relationships as rel, stats

KINDS = {"numbers": "SELECT 1 AS a, 2.5D AS b", "texts": "SELECT 'x' AS t",
         "dates": "SELECT timestamp'2024-01-01 00:00:00' AS d", "nothing": "SELECT array(1) AS n"}
OPERATORS = [stats.numeric_stats, stats.integer_stats, stats.basic_stats, stats.date_stats, stats.text_stats, stats.histogram,
             stats.iqr_outliers, stats.box_plot, stats.correlation_matrix, infer.infer_types]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_any_table(spark, operator, kind):
    full = spark.sql("SELECT 1 AS a, 2.5D AS b, 'x' AS t, timestamp'2024-01-01 00:00:00' AS d")
    found = operator(spark.sql(KINDS[kind]))
    found.collect()
    assert found.columns == operator(full).columns


def test_outlier_points_without_numbers(spark):
    df = spark.sql("SELECT 'x' AS id, 'y' AS t")
    assert stats.outlier_points(df, "id").collect() == []


def test_no_keys(spark):
    tables = {"t": spark.sql("SELECT 1 AS a")}
    assert rel.relationship_stats(tables, []).count() == 0
    assert quality.key_violations(tables, {}).count() == 0
    assert quality.key_violations(tables, {"t": []}).count() == 0


@pytest.mark.parametrize("child, parent, orphans", [
    ("decimal(20,2)", "bigint", 0), ("bigint", "decimal(20,2)", 0), ("decimal(10,3)", "decimal(30,1)", 0),
    ("decimal(20,2)", "double", 0), ("int", "double", 0), ("double", "bigint", 0),
    ("decimal(38,0)", "decimal(38,10)", 0), ("decimal(38,18)", "bigint", 0), ("decimal(38,36)", "decimal(38,0)", 0),
    ("double", "decimal(38,18)", 0)])
def test_exact_keys_meet(spark, child, parent, orphans):
    tables = {"c": spark.range(5).selectExpr(f"cast(id AS {child}) AS k"),
              "p": spark.range(5).selectExpr(f"cast(id AS {parent}) AS k")}
    fk = ForeignKey("c", "k", "p", "k")
    assert rel.fk_integrity(tables, [fk]).first()["orphaned_count"] == orphans
    assert rel.orphans(tables["c"], "k", tables["p"], "k").count() == orphans


def test_large_integers_stay_apart(spark):
    tables = {"c": spark.sql("SELECT 9007199254740993L AS k"), "p": spark.sql("SELECT 9007199254740992D AS k")}
    assert rel.fk_integrity(tables, [ForeignKey("c", "k", "p", "k")]).first()["orphaned_count"] == 1


def test_large_decimals_stay_apart_from_doubles(spark):
    tables = {"c": spark.sql("SELECT 9007199254740993BD AS k UNION ALL SELECT 0.1BD"),
              "p": spark.sql("SELECT 9007199254740992D AS k UNION ALL SELECT 0.1D")}
    assert rel.fk_integrity(tables, [ForeignKey("c", "k", "p", "k")]).first()["orphaned_count"] == 1


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_normal_form_of_exact_numbers(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.sql("SELECT cast(x AS decimal(38,18)) AS d FROM VALUES ('0'), ('-0.5'), ('1e-18'), ('1200'), "
                       "('-12345678901234567890.10'), ('99999999999999999999.999999999999999999') AS v(x)")
        text = [r[0] for r in df.selectExpr(exprs.plain_number(df.schema[0])).collect()]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert text == ["0", "-0.5", "0.000000000000000001", "1200", "-12345678901234567890.1",
                    "99999999999999999999.999999999999999999"]


def test_an_unrelated_column_changes_no_inclusion(spark):
    tables = {"c": spark.range(5).selectExpr("cast(id AS decimal(10,0)) AS k"),
              "p": spark.range(9).selectExpr("id AS k"),
              "q": spark.range(0, 18, 2).selectExpr("cast(id / 2 AS decimal(20,4)) AS k")}
    pairs = lambda t: {(r["child_table"], r["parent_table"]) for r in discovery.inclusions(t).collect()}
    alone = pairs(tables)
    assert alone == {("c", "p"), ("c", "q"), ("p", "q"), ("q", "p")}
    wide = spark.sql("SELECT 7BD * cast(1e30 AS decimal(38,0)) AS a, cast(0.25 AS decimal(38,18)) AS b")
    assert pairs({**tables, "w": wide}) == alone
    found = {(r["child_table"], r["parent_table"]) for r in discovery.discover_fks({**tables, "w": wide}).collect()}
    assert found == alone


def test_inclusions_across_exact_types(spark):
    tables = {"c": spark.range(5).selectExpr("cast(id AS decimal(20,2)) AS k"),
              "p": spark.range(9).selectExpr("id AS k")}
    found = {(r["child_table"], r["parent_table"]) for r in discovery.inclusions(tables).collect()}
    assert found == {("c", "p")}


def test_text_values_travel_as_digests(spark):
    tables = {"a": spark.sql("SELECT 'long text' AS t"), "b": spark.sql("SELECT 'long text' AS u")}
    plan = discovery._value_masks(tables, [("a", "t"), ("b", "u")], "text")
    assert plan.schema["value"].dataType.typeName() == "binary"
    assert discovery.inclusions(tables).count() == 2


def test_samples_come_from_the_whole_table(spark):
    from tablescope.operators import catalog

    df = spark.range(20).selectExpr("id", "if(id >= 6, concat('v', id), NULL) AS late", "cast(NULL AS string) AS never")
    tables = {"t": df}
    cat = catalog.Catalog(catalog.extract_tables(tables), catalog.extract_columns(tables), rel.fk_relation(spark, []))
    found = {r["column"]: r["samples"] for r in catalog.column_dictionary(cat, tables, {"t": ["id"]}).collect()}
    assert found == {"id": "0 | 1 | 2", "late": "v6 | v7 | v8", "never": ""}


def test_malformed_rows_are_kept_and_counted(spark, tmp_path):
    from tablescope.sources import readers

    path = tmp_path / "two.csv"
    path.write_text('a,b\n1,2\n3,4,5\n6\n"x\ny",7\n')
    found = readers.read_csv(spark, str(path), malformed="bad")
    assert sorted(r["bad"] or "" for r in found.collect()) == ["", "", "3,4,5", "6"]
    assert [tuple(r) for r in readers.csv_malformed(spark, [str(path)]).collect()] == [("two", 4, 2)]
    assert len(readers.read_any(spark, str(path), multi_line=False)["two"].collect()) == 5


def test_unreadable_documents_are_counted(spark):
    from tablescope.sources import readers

    df = spark.createDataFrame([('{"a": 1}',), ("nope",), ("[1]",), (None,)], "d string")
    assert tuple(readers.unreadable_documents(df, "d").first()) == (3, 2)


def test_wide_correlations_take_one_scan(spark, tmp_path):
    from tablescope.operators import stats

    exprs = [f"sin(id * {i + 1}) + id * {i % 3} AS c{i}" for i in range(60)]
    spark.range(50).selectExpr(*exprs, "1.0D AS k").write.parquet(str(tmp_path / "w"))
    df = spark.read.parquet(str(tmp_path / "w"))
    wide = stats.correlation_matrix(df)
    assert wide._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = {tuple(r)[:2]: r[2] for r in wide.collect()}
    assert len(found) == 61 * 61
    for a, b, r in stats.correlation_matrix(df, ["c1", "c2", "c7", "k"]).collect():
        assert (r is None) == (found[a, b] is None) and abs((r or 0) - (found[a, b] or 0)) < 1e-9


def test_histogram_counts_infinite_values_apart(spark):
    from tablescope.operators import stats

    df = spark.sql("SELECT * FROM VALUES (double('Infinity')), (double('-Infinity')), (1D), (2D), "
                   "(double('NaN')), (NULL) AS t(v)")
    rows = [tuple(r)[1:] for r in stats.histogram(df, bins=2).orderBy("bin").collect()]
    inf = float("inf")
    assert rows == [(0, -inf, -inf, 1), (1, 1.0, 1.5, 1), (2, 1.5, 2.0, 1), (3, inf, inf, 1)]


def test_ranges_of_large_integers_are_exact(spark):
    from tablescope.operators import stats

    df = spark.sql("SELECT * FROM VALUES (9007199254740993), (9007199254740995) AS t(v)")
    assert stats.moments(df).first()["range"] == 2.0


def test_profile_shuffles_digests_of_texts(spark):
    from tablescope.operators import profile

    df = spark.range(3).selectExpr("if(id < 2, concat('a long text ', id DIV 2), NULL) AS t")
    row = profile.frequency_summary({"x": df}).first()
    assert (row["row_count"], row["null_count"], row["distinct_count"]) == (3, 1, 1)
    assert "sha2" in profile.frequency_summary({"x": df})._jdf.queryExecution().optimizedPlan().toString()


def test_scores_sort_like_columns(spark):
    from tablescope.operators import profile

    df = spark.sql("SELECT * FROM VALUES ('b', 3), ('a', 3), ('c', NULL) AS t(table, score)")
    assert [r[0] for r in profile.sort_columns(df, "score").collect()] == ["a", "b", "c"]
