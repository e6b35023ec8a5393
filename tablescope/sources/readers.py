"""Reading tables: CSV files, JSON documents, databases, and files by extension."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.exprs import col

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json",
           ".parquet": "parquet", ".orc": "orc"}


def table_name(path: str) -> str:
    """File stem reduced to word characters; a leading digit gets the prefix t_."""
    stem = re.sub(r"\.[^/.]+$", "", PurePosixPath(path.rstrip("/")).name)
    name = re.sub(r"\W", "", stem, flags=re.ASCII)
    return f"t_{name}" if re.match(r"\d", name) else name


def read_csv(spark: SparkSession, path: str, multi_line: bool = True,
             malformed: str | None = None) -> DataFrame:
    """One CSV as text columns: header row, doubled quotes, empty cells as NULL.

    Types are inferred afterwards on all values. `multi_line` allows line breaks inside
    quoted fields at the price that a file is not split; switch it off for large plain
    files. Rows with more or fewer cells than the header lose or lack cells; `malformed`
    names a further column that holds the whole text of such rows (NULL in others).
    """
    reader = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
              .option("multiLine", multi_line).option("nullValue", "").option("emptyValue", "")
              .option("inferSchema", False).option("mode", "PERMISSIVE"))
    if malformed is None:
        return reader.csv(path)
    names = reader.csv(path).columns
    if malformed in names:
        raise ValueError(f"the file has a column {malformed!r}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, malformed]])
    # all cells of a row must be parsed to know whether it is malformed
    return (reader.option("columnNameOfCorruptRecord", malformed).option("columnPruning", False)
            .schema(schema).csv(path))


def csv_malformed(spark: SparkSession, paths: Sequence[str], multi_line: bool = True) -> DataFrame:
    """(table, rows, malformed_rows) of CSV files: rows whose number of cells differs from
    the header's are counted, not passed over."""
    mark, parts = "__malformed", []
    for path in paths:
        df = read_csv(spark, path, multi_line, mark)
        cell = col(df.columns[0])  # the mark alone is not to be had without a cell
        parts.append(df.agg((F.count(cell) + F.count_if(cell.isNull())).alias("rows"),
                            F.count(col(mark)).alias("malformed_rows"))
                     .select(F.lit(table_name(path)).alias("table"), "rows", "malformed_rows"))
    return reduce(DataFrame.unionByName, parts)


def read_csvs(spark: SparkSession, paths: Sequence[str], multi_line: bool = True,
              malformed: str | None = None) -> dict[str, DataFrame]:
    """One table per CSV path, named after the file; `malformed` as in `read_csv`."""
    return {table_name(p): read_csv(spark, p, multi_line, malformed) for p in paths}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A document collection: one JSON object per line, kept as text."""
    return spark.read.text(path).select(F.col("value").alias("document"))


def document_fields(df: DataFrame, json_column: str) -> DataFrame:
    """Top-level fields over all documents with the number of documents holding each.

    `_id` is the key of a collection; fields are typed `object`.
    """
    keys = df.select(F.explode(F.json_object_keys(col(json_column))).alias("field"))
    return keys.groupBy("field").agg(F.count(F.lit(1)).alias("documents")).select(
        "field", "documents", F.lit("object").alias("type"),
        (F.col("field") == "_id").alias("primary_key"))


def unreadable_documents(df: DataFrame, json_column: str) -> DataFrame:
    """(documents, unreadable): documents that do not parse or are no object have no
    fields in `document_fields`; here they are counted."""
    text = col(json_column)
    return df.agg(F.count(text).alias("documents"), F.count_if(
        text.isNotNull() & F.json_object_keys(text).isNull()).alias("unreadable"))


def read_any(spark: SparkSession, path: str, multi_line: bool = True, malformed: str | None = None
             ) -> dict[str, DataFrame]:
    """Choose the reader by extension; the path may be on any Hadoop file system.
    `multi_line=False` lets large CSV files be split; `malformed` names the column that
    holds CSV rows with too many or too few cells."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for {suffix or path!r}; known: {sorted(FORMATS)}")
    if suffix == ".csv":
        return read_csvs(spark, [path], multi_line, malformed)
    return {table_name(path): spark.read.format(FORMATS[suffix]).load(path)}


def jdbc_columns(spark: SparkSession, url: str, schema: str, properties: Mapping[str, str]
                 ) -> DataFrame:
    """Columns of a database from its information schema."""
    if not re.fullmatch(r"\w+", schema):
        raise ValueError("schema must be a plain identifier")
    query = ("(select table_name, column_name, ordinal_position, data_type, is_nullable "
             f"from information_schema.columns where table_schema = '{schema}') q")
    return spark.read.jdbc(url, query, properties=dict(properties))


def read_jdbc_tables(spark: SparkSession, url: str, tables: Sequence[str],
                     partition_col: Mapping[str, tuple[str, int, int]] | None = None,
                     partitions: int = 64, properties: Mapping[str, str] | None = None
                     ) -> dict[str, DataFrame]:
    """Tables of a live database; needs the driver jar on the class path.

    `partition_col` names (column, lower, upper) per table: the table is then read in
    parallel ranges. The bounds only set the stride; rows outside are read as well.
    """
    found = {}
    for name in tables:
        options = dict(properties or {})
        split = (partition_col or {}).get(name)
        if split:
            column, low, high = split
            found[name] = spark.read.jdbc(url, name, column=column, lowerBound=low,
                                          upperBound=high, numPartitions=partitions,
                                          properties=options)
        else:
            found[name] = spark.read.jdbc(url, name, properties=options)
    return found
