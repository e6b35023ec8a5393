"""Portable SQL: target types, CREATE TABLE text and INSERT statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.exprs import col
from ..operators.catalog import Catalog

DIALECTS = ("mysql", "postgres", "oracle")

# --- fixed values: type and statement texts ----------------------------------------
# name part -> target type, first match wins; None is the type for everything else
TARGET_TYPES = {
    "postgres": ((("int",), "INTEGER"), (("char",), "VARCHAR(255)"),
                 (("real", "float"), "DOUBLE PRECISION"), (("blob",), "BYTEA"), (None, "TEXT")),
    "oracle": ((("int",), "NUMBER(12,0)"), (("char",), "VARCHAR2(255)"),
               (("real", "float"), "NUMBER"), (("blob",), "BLOB"), (None, "CLOB")),
    "mysql": ((("int",), "INT"), (("char",), "VARCHAR(255)"), (("real",), "DOUBLE"),
              (("blob",), "LONGBLOB"), (None, "LONGTEXT")),
}
POSTGRES_KEY_INTEGER = "SERIAL"
PROLOGUE = {"postgres": "SET check_function_bodies = false;",
            "mysql": "SET NAMES utf8mb4;\nSET FOREIGN_KEY_CHECKS = 0;", "oracle": ""}
EPILOGUE = {"mysql": "SET FOREIGN_KEY_CHECKS = 1;", "postgres": "", "oracle": ""}
# -------------------------------------------------------------------------------------


def _check(dialect: str) -> None:
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")


def quote_mark(dialect: str) -> str:
    _check(dialect)
    return "`" if dialect == "mysql" else '"'


def marked(name: Column, dialect: str) -> Column:
    mark = F.lit(quote_mark(dialect))
    return F.concat(mark, name, mark)


def target_type(type_name: Column, dialect: str, is_key: Column) -> Column:
    """Type of a column in the target dialect, by parts of its source type name."""
    _check(dialect)
    lower = F.lower(type_name)
    result, fallback = None, None
    for parts, target in TARGET_TYPES[dialect]:
        if parts is None:
            fallback = target
            continue
        value = F.lit(target)
        if dialect == "postgres" and "int" in parts:
            value = F.when(is_key, F.lit(POSTGRES_KEY_INTEGER)).otherwise(value)
        test = None
        for part in parts:
            here = F.contains(lower, F.lit(part))
            test = here if test is None else test | here
        result = F.when(test, value) if result is None else result.when(test, value)
    return result.otherwise(F.lit(fallback))


def type_mapping(columns: DataFrame) -> DataFrame:
    """Target type of every catalog column in each dialect."""
    key = F.col("primary_key")
    return columns.select("table", "column", "type", "primary_key",
                          *[target_type(F.col("type"), d, key).alias(d) for d in DIALECTS])


def table_ddl(cat: Catalog, dialect: str) -> DataFrame:
    """(table, ddl): CREATE TABLE text of every table of a catalog.

    The lines gathered per table are its columns, so their number is that of the schema.
    """
    key = F.col("primary_key")
    line = F.concat(F.lit("  "), marked(F.col("column"), dialect), F.lit(" "),
                    target_type(F.col("type"), dialect, key))
    if dialect != "postgres":
        line = F.concat(line, F.when(key, " NOT NULL").otherwise(""))
    entries = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))
    keys = F.array_sort(F.collect_list(F.when(key, F.struct(
        "ordinal", marked(F.col("column"), dialect).alias("name")))))
    name = marked(F.col("table"), dialect)
    head = F.concat(F.lit(f"DROP TABLE IF EXISTS "), name, F.lit(";\n")) if dialect == "mysql" \
        else F.lit("")
    body = F.concat(
        F.array_join(F.transform("entries", lambda e: e["line"]), ",\n"),
        F.when(F.size("keys") > 0, F.concat(
            F.lit(",\n  PRIMARY KEY ("),
            F.array_join(F.transform("keys", lambda k: k["name"]), ", "), F.lit(")")))
        .otherwise(F.lit("")))
    return cat.columns.groupBy("table").agg(entries.alias("entries"), keys.alias("keys")).select(
        "table", F.concat(head, F.lit("CREATE TABLE "), name, F.lit(" (\n"), body,
                          F.lit("\n);")).alias("ddl"))


def sql_literal(field: T.StructField) -> Column:
    """A value as SQL text: NULL, bare number, or quoted text with quotes doubled."""
    value = col(field.name)
    if isinstance(field.dataType, T.NumericType):
        text = value.cast("string")
    else:
        text = F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")),
                        F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def insert_statements(df: DataFrame, table: str, dialect: str) -> DataFrame:
    """(statement): one INSERT per row, built where the row is."""
    mark = quote_mark(dialect)
    names = ", ".join(f"{mark}{c}{mark}" for c in df.columns)
    values = F.concat_ws(", ", *[sql_literal(f) for f in df.schema.fields])
    return df.select(F.concat(F.lit(f"INSERT INTO {mark}{table}{mark} ({names}) VALUES ("),
                              values, F.lit(");")).alias("statement"))


def write_sql_script(tables, cat: Catalog, dialect: str, path: str) -> None:
    """Write a script folder: 0_begin, one folder of DDL, one of rows per table, 9_end.

    Rows are written by the tasks that read them, one part file each; concatenating the
    folders in name order gives the script.
    """
    _check(dialect)
    spark = next(iter(tables.values())).sparkSession
    for name, text in (("0_begin", PROLOGUE[dialect]), ("9_end", EPILOGUE[dialect])):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(
            "overwrite").text(f"{path}/{name}")
    table_ddl(cat, dialect).select(F.col("ddl").alias("value")).write.mode("overwrite").text(
        f"{path}/1_tables")
    for name, df in tables.items():
        insert_statements(df, name, dialect).select(F.col("statement").alias("value")).write.mode(
            "overwrite").text(f"{path}/2_rows_{name}")
