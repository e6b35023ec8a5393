"""A stored catalog: measured once, read by every consumer, kept up by partition.

A store is a folder of Parquet. Each saved catalog is a version in a folder of its own,
and a row of the manifest, written last, makes it visible; a writer that dies leaves no
half version. Profiles of the parts of a table (a day, a load) are kept as states that
merge, so new rows cost a scan of the new rows alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exprs import (by_place, cast, chunks, family, literal, long_rows, measure, present,
                               union_all)
from ..operators.catalog import Catalog
from ..operators.profile import finish_profile
from ..policy import DEFAULT_POLICY, QualityPolicy
from .writers import write_catalog, write_report

Tables = Mapping[str, DataFrame]

MANIFEST_SCHEMA = "key string, version string, written_at timestamp, tables bigint, columns bigint"
#: 2^14 registers a column: distinct counts are within 2.5 % (three standard errors).
SKETCH_BITS = 14
STATE_COLUMNS_PER_AGGREGATE = 25


@dataclass(frozen=True)
class StoredCatalog:
    """A version of a store: the catalog, and the column profile it was measured with."""

    version: str
    catalog: Catalog
    profile: DataFrame


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(key, version, written_at, tables, columns) of every complete version; empty without a store."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def save_catalog(cat: Catalog, profile: DataFrame, path: str, key: str = "") -> str:
    """Write a version and enter it in the manifest; the name of the version.

    `key` says which state of the data was measured (a snapshot id, a load date).
    """
    spark = cat.tables.sparkSession
    version = uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    write_catalog(cat, folder)
    write_report(profile, f"{folder}/profile", "parquet")
    stored = _relations(spark, folder)
    (stored["tables"].agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("column_count"), F.lit(0)).alias("columns"))
     .select(F.lit(key).alias("key"), F.lit(version).alias("version"),
             F.current_timestamp().alias("written_at"), "tables", F.col("columns").cast("bigint").alias("columns"))
     .write.mode("append").parquet(f"{path}/manifest"))
    return version


def _relations(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("tables", "columns", "fks", "profile")}


def load_catalog(spark: SparkSession, path: str, key: str | None = None) -> StoredCatalog | None:
    """The newest version, of that key if one is given; None where there is none.

    Reading it costs scans of schema size, whatever the size of the tables.
    """
    known = manifest(spark, path)
    if key is not None:
        known = known.where(F.col("key") == key)
    newest = known.orderBy(F.desc("written_at"), "version").select("version").first()
    if newest is None:
        return None
    found = _relations(spark, f"{path}/versions/{newest['version']}")
    return StoredCatalog(newest["version"], Catalog(found["tables"], found["columns"], found["fks"]),
                         found["profile"])


def stored_catalog(spark: SparkSession, path: str, key: str,
                   build: Callable[[], tuple[Catalog, DataFrame]]) -> StoredCatalog:
    """The stored catalog of that key; measured by `build` and saved where there is none."""
    found = load_catalog(spark, path, key)
    if found is None:
        save_catalog(*build(), path, key)
        found = load_catalog(spark, path, key)
    return found


# --- profiles by part --------------------------------------------------------------------

def profile_state(tables: Tables) -> DataFrame:
    """(table, ordinal, column, type, row_count, filled, sketch): a column profile that merges.

    One scan per table and no shuffle of values: each task sends a counter and a sketch of
    fixed size per column. Nested columns have no sketch.
    """
    parts = []
    for name, df in tables.items():
        placed = by_place(df)
        fields = [(i, f, placed.schema[i - 1]) for i, f in enumerate(df.schema.fields, start=1)]
        for chunk in chunks(fields, STATE_COLUMNS_PER_AGGREGATE):
            aggs = {"n": "count(1)"}
            for i, _, f in chunk:
                aggs[f"f{i}"] = f"count({present(f)})"
                kind = family(f.dataType)
                if kind:
                    # -0.0 and 0.0 are one number
                    value = present(f) if kind != "fractional" else f"({present(f)} + 0)"
                    text = cast(value, "integral" if kind == "integral" else "string")
                    aggs[f"s{i}"] = f"hll_sketch_agg({text}, {SKETCH_BITS})"
                else:
                    aggs[f"s{i}"] = "max(cast(NULL AS binary))"
            parts.append(long_rows(measure(placed, aggs), [{
                    "table": literal(name), "ordinal": str(i), "column": literal(f.name),
                    "type": literal(f.dataType.simpleString()), "row_count": "n", "filled": f"f{i}",
                    "sketch": f"s{i}"} for i, f, _ in chunk]))
    return union_all(parts)


def write_profile_part(tables: Tables, path: str, part: str) -> None:
    """Store the state of one part of the tables; writing a part again replaces it."""
    (profile_state(tables).withColumn("part", F.lit(part)).coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/profile_parts"))


def merged_profile(states: DataFrame, policy: QualityPolicy = DEFAULT_POLICY) -> DataFrame:
    """The column profile of all parts together, in the columns of `column_profile`.

    Row and null counts are exact, distinct counts come from the merged sketches. A column
    is that of a name and type at a place: after a change of schema both are listed.
    """
    distinct = F.expr("hll_sketch_estimate(hll_union_agg(sketch))")
    counted = states.groupBy("table", "ordinal", "column", "type").agg(
        F.sum("row_count").alias("row_count"), F.sum(F.col("row_count") - F.col("filled")).alias("null_count"),
        F.when(F.count("sketch") > 0, F.least(distinct, F.sum("filled"))).alias("distinct_count"))
    return finish_profile(counted, policy)


def read_profile(spark: SparkSession, path: str, policy: QualityPolicy = DEFAULT_POLICY) -> DataFrame:
    """The profile of all parts that `write_profile_part` has stored."""
    return merged_profile(spark.read.parquet(f"{path}/profile_parts"), policy)
