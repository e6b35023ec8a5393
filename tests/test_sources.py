"""Readers, writers, type inference and SQL text."""

import pytest
from pyspark.sql import functions as F

from tablescope.operators import catalog as cat, infer
from tablescope.sources import readers, sqltext, writers

from .conftest import rows


def test_table_names():
    assert readers.table_name("/data/2024-sales report.csv") == "t_2024salesreport"
    assert readers.table_name("hdfs://x/y/orders.v2.parquet/") == "ordersv2"


def test_csv_with_quotes_breaks_and_gaps(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('id,name,note\n1,"Ann ""A"" B","two\nlines, one cell"\n\n2,,\n')
    df = readers.read_csvs(spark, [str(path)])["people"]
    assert rows(df) == [("1", 'Ann "A" B', "two\nlines, one cell"), ("2", None, None)]


def test_csv_written_is_csv_read(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi"\nthere', None), ("2", "a,b", "\\")],
                               "id string, text string, more string")
    path = str(tmp_path / "round.csv")
    writers.write_csv(df, path)
    assert rows(readers.read_any(spark, path)["round"]) == rows(df)


def test_read_any_knows_its_formats(spark, tmp_path):
    df = spark.range(3)
    for fmt in ("parquet", "json", "orc"):
        df.write.format(fmt).save(str(tmp_path / f"r.{fmt}"))
        assert readers.read_any(spark, str(tmp_path / f"r.{fmt}"))["r"].count() == 3
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.db")


def test_document_fields_cover_all_documents(spark, tmp_path):
    path = tmp_path / "docs.json"
    path.write_text('{"_id": 1, "a": {"b": 2}}\n{"_id": 2, "late": null}\n')
    got = readers.document_fields(readers.read_documents(spark, str(path)), "document")
    assert rows(got) == [("_id", 2, "object", True), ("a", 1, "object", False),
                         ("late", 1, "object", False)]


TEXTS = [
    ("whole", ["1", "-2", "3.0"], "INTEGER", "INTEGER", "REAL"),
    ("real", ["1.5", "2e3", None], "REAL", "VARCHAR(255)", "TEXT"),
    ("bit", ["0", "1", ""], "INTEGER", "BOOLEAN", "INTEGER"),
    ("word", ["true", "FALSE", "1"], "TEXT", "BOOLEAN", "TEXT"),
    ("day", ["2024-01-02", "2024-01-03", "2024-02-30"], "DATETIME", "VARCHAR(255)", "DATETIME"),
    ("old", ["1999-01-02", "1998-01-03", "1999-04-05"], "DATETIME", "VARCHAR(255)", "DATETIME"),
    ("slash", ["01/02/2024", "02/02/2024", "03/02/2024"], "DATETIME", "VARCHAR(255)", "TEXT"),
    ("none", [None, "", None], "TEXT", "VARCHAR(255)", "TEXT"),
    ("words", ["a", "b", "1"], "TEXT", "VARCHAR(255)", "TEXT"),
]


def test_types_in_all_modes(spark):
    df = spark.createDataFrame(list(zip(*[t[1] for t in TEXTS])),
                               ", ".join(f"`{t[0]}` string" for t in TEXTS))
    expected = {mode: {t[0]: t[2 + i] for t in TEXTS} for i, mode in enumerate(infer.MODES)}
    # "2e3" reads as a number without a point beside one with a point
    expected["sample5"]["real"] = "REAL"
    # "3.0" has a point, so the column is no plain integer in this mode
    expected["sample5"]["whole"] = "REAL"
    for mode in infer.MODES:
        assert infer.type_map(infer.infer_types(df, mode)) == expected[mode], mode


def test_loading_counts_what_is_lost(spark):
    df = spark.createDataFrame([("1", "2024-01-02 03:04:05"), ("x", "05/06/2024"), ("", "never")],
                               "n string, d string")
    types = {"n": "INTEGER", "d": "DATETIME"}
    assert rows(infer.cast_failures(df, types).select("column", "failures")) == [("d", 1), ("n", 1)]
    loaded = infer.apply_types(df, types)
    assert [f.dataType.simpleString() for f in loaded.schema] == ["bigint", "timestamp_ntz"]
    assert loaded.where("d = timestamp_ntz'2024-05-06'").count() == 1


def catalog_of(spark):
    tables = {"t": spark.createDataFrame([(1, "it's", None), (2, None, 1.5)],
                                         "id int, name string, x double")}
    keys = spark.createDataFrame([("t", "id")], "table string, column string")
    fks = spark.createDataFrame([], "child_table string, child_column string, parent_table string, "
                                    "parent_column string, inferred boolean")
    return tables, cat.extract_catalog(tables, keys, fks)


def test_ddl_and_inserts(spark):
    tables, catalog = catalog_of(spark)
    mysql = sqltext.table_ddl(catalog, "mysql").first()["ddl"]
    assert mysql == ("DROP TABLE IF EXISTS `t`;\nCREATE TABLE `t` (\n  `id` INT NOT NULL,\n"
                     "  `name` LONGTEXT,\n  `x` LONGTEXT,\n  PRIMARY KEY (`id`)\n);")
    assert '"id" SERIAL,' in sqltext.table_ddl(catalog, "postgres").first()["ddl"]
    assert '"id" NUMBER(12,0) NOT NULL' in sqltext.table_ddl(catalog, "oracle").first()["ddl"]
    assert rows(sqltext.insert_statements(tables["t"], "t", "postgres")) == [
        ("INSERT INTO \"t\" (\"id\", \"name\", \"x\") VALUES (1, 'it''s', NULL);",),
        ('INSERT INTO "t" ("id", "name", "x") VALUES (2, NULL, 1.5);',)]


def test_type_map_parts(spark):
    names = spark.createDataFrame([(n,) for n in ("BIGINT", "varchar(9)", "float", "real", "blob",
                                                  "date")], "n string")
    got = {r["n"]: (r["p"], r["o"], r["m"]) for r in names.select("n", *[
        sqltext.target_type(F.col("n"), d, F.lit(False)).alias(d[0])
        for d in ("postgres", "oracle", "mysql")]).collect()}
    assert got == {"BIGINT": ("INTEGER", "NUMBER(12,0)", "INT"),
                   "varchar(9)": ("VARCHAR(255)", "VARCHAR2(255)", "VARCHAR(255)"),
                   "float": ("DOUBLE PRECISION", "NUMBER", "LONGTEXT"),
                   "real": ("DOUBLE PRECISION", "NUMBER", "DOUBLE"),
                   "blob": ("BYTEA", "BLOB", "LONGBLOB"), "date": ("TEXT", "CLOB", "LONGTEXT")}


def test_scripts_dictionaries_and_catalogs_are_written(spark, tmp_path):
    tables, catalog = catalog_of(spark)
    sqltext.write_sql_script(tables, catalog, "mysql", str(tmp_path / "script"))
    assert spark.read.text(str(tmp_path / "script" / "2_rows_t")).count() == 2
    assert spark.read.text(str(tmp_path / "script" / "0_begin")).count() == 2
    writers.write_catalog(catalog, str(tmp_path / "catalog"))
    assert spark.read.parquet(str(tmp_path / "catalog" / "columns")).count() == 3
    dictionary = cat.column_dictionary(catalog, tables, {"t": ["id"]})
    assert {r["column"]: r["samples"] for r in dictionary.collect()} == {
        "id": "1 | 2", "name": "it's", "x": "1.5"}
    writers.write_dictionary_csv(dictionary, str(tmp_path / "dictionary.csv"))
    assert readers.read_any(spark, str(tmp_path / "dictionary.csv"))["dictionary"].count() == 3
