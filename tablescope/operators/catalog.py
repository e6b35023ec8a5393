"""The catalog as flat relations, and the rules that read it.

The catalog's size is that of the schema, not of the data; row counts, keys and
nullability in it are measured on the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import by_place, col, place_of, small_relation, union_all
from ..policy import AMBIGUOUS_NAMES
from .profile import row_counts

Tables = Mapping[str, DataFrame]

COLUMN_SCHEMA = ("table string, ordinal int, column string, type string, nullable boolean, "
                 "primary_key boolean, unique boolean, default_value string")
KEY_COLUMNS = ("table", "column")


@dataclass(frozen=True)
class Catalog:
    """tables(table, position, row_count, column_count), columns(...), fks(...)."""

    tables: DataFrame
    columns: DataFrame
    fks: DataFrame


def extract_columns(tables: Tables) -> DataFrame:
    """Columns as the sources declare them; keys unmarked."""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable, False, False, None)
            for name, df in tables.items() for i, f in enumerate(df.schema.fields, start=1)]
    return small_relation(next(iter(tables.values())).sparkSession, rows, COLUMN_SCHEMA)


def extract_tables(tables: Tables) -> DataFrame:
    """Row and column count per table, in load order."""
    order = [(name, i, len(df.columns)) for i, (name, df) in enumerate(tables.items(), start=1)]
    spark = next(iter(tables.values())).sparkSession
    known = small_relation(spark, order, "table string, position int, column_count int")
    return row_counts(tables).join(known, "table").select(
        "table", "position", "row_count", "column_count")


def mark_keys(columns: DataFrame, primary: DataFrame, unique: DataFrame | None = None
              ) -> DataFrame:
    """Set the key flags from (table, column) relations of primary and unique columns."""
    pk = primary.select(*KEY_COLUMNS).distinct().withColumn("pk", F.lit(True))
    marked = columns.join(pk, list(KEY_COLUMNS), "left")
    if unique is not None:
        uq = unique.select(*KEY_COLUMNS).distinct().withColumn("uq", F.lit(True))
        marked = marked.join(uq, list(KEY_COLUMNS), "left")
    else:
        marked = marked.withColumn("uq", F.lit(None).cast("boolean"))
    return marked.select(
        "table", "ordinal", "column", "type", "nullable",
        (F.col("primary_key") | F.coalesce("pk", F.lit(False))).alias("primary_key"),
        (F.col("unique") | F.coalesce("uq", F.lit(False))).alias("unique"), "default_value")


def observed_nullability(columns: DataFrame, profile: DataFrame) -> DataFrame:
    """Replace the declared nullability by what the data shows."""
    seen = profile.select("table", "ordinal", (F.col("null_count") > 0).alias("has_null"))
    return columns.join(seen, ["table", "ordinal"], "left").withColumn(
        "nullable", F.coalesce("has_null", "nullable")).drop("has_null").select(*columns.columns)


def extract_catalog(tables: Tables, primary: DataFrame, fks: DataFrame,
                    unique: DataFrame | None = None, profile: DataFrame | None = None) -> Catalog:
    """Assemble the catalog; a `profile` adds observed nullability."""
    columns = mark_keys(extract_columns(tables), primary, unique)
    if profile is not None:
        columns = observed_nullability(columns, profile)
    return Catalog(extract_tables(tables), columns, fks)


# --- foreign keys ------------------------------------------------------------------

def infer_fks_by_name(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns ending in _id that several tables share become foreign keys.

    The parent is the first table, in load order, whose name holds the column's prefix,
    else the alphabetically first; every other table is a child.
    """
    shared = columns.where(F.col("column").endswith("_id")).join(
        tables.select("table", "position"), "table")
    prefix = F.lower(F.expr("left(column, length(column) - 3)"))
    named = F.contains(F.lower("table"), prefix)
    parents = shared.groupBy("column").agg(
        F.count(F.lit(1)).alias("uses"),
        F.min(F.when(named, F.struct("position", "table"))).alias("by_name"),
        F.min("table").alias("by_order")).where(F.col("uses") >= 2).select(
        "column", F.coalesce("by_name.table", "by_order").alias("parent_table"))
    return (shared.join(parents, "column").where(F.col("table") != F.col("parent_table"))
            .select(F.col("table").alias("child_table"), F.col("column").alias("child_column"),
                    "parent_table", F.col("column").alias("parent_column"),
                    F.lit(True).alias("inferred")))


def merge_fks(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """Declared and inferred keys; a declared one for the same column and parent wins."""
    return declared.unionByName(inferred.join(
        declared, ["child_table", "child_column", "parent_table"], "left_anti"))


def fk_source_label(fks: DataFrame) -> DataFrame:
    """explicit, inferred or mixed; explicit when there is no foreign key."""
    some_inferred = F.coalesce(F.bool_or("inferred"), F.lit(False))
    some_declared = F.coalesce(F.bool_or(~F.col("inferred")), F.lit(False))
    return fks.agg(F.when(some_inferred & some_declared, "mixed").when(some_inferred, "inferred")
                   .otherwise("explicit").alias("fk_source"))


def relationships(fks: DataFrame, cardinality: DataFrame | None = None) -> DataFrame:
    """Edge list with cardinality, one-to-many where it was not measured."""
    named = fks.select(F.col("child_table").alias("from_table"),
                       F.col("child_column").alias("from_column"),
                       F.col("parent_table").alias("to_table"),
                       F.col("parent_column").alias("to_column"), "inferred")
    if cardinality is None:
        return named.withColumn("cardinality", F.lit("one-to-many"))
    measured = cardinality.select(F.col("child_table").alias("from_table"),
                                  F.col("child_column").alias("from_column"),
                                  F.col("parent_table").alias("to_table"),
                                  F.col("parent_column").alias("to_column"), "cardinality")
    return named.join(measured, ["from_table", "from_column", "to_table", "to_column"],
                      "left").withColumn("cardinality", F.coalesce("cardinality",
                                                                   F.lit("one-to-many")))


# --- totals and listings -------------------------------------------------------------

def catalog_totals(tables: DataFrame) -> DataFrame:
    return tables.agg(F.count(F.lit(1)).alias("total_tables"),
                      F.sum("column_count").alias("total_columns"),
                      F.sum("row_count").alias("total_rows"))


def catalog_meta(cat: Catalog, database_name: str, input_type: str, extracted_at: datetime | str
                 ) -> DataFrame:
    """The one-row description of a catalog."""
    return catalog_totals(cat.tables).withColumn("k", F.lit(1)).join(
        fk_source_label(cat.fks).withColumn("k", F.lit(1)), "k").select(
        F.lit(database_name).alias("database_name"), F.lit(input_type).alias("input_type"),
        "total_tables", "total_columns", "total_rows", "fk_source",
        F.lit(str(extracted_at)).cast("timestamp_ntz").alias("extraction_timestamp"))


def search_tables(tables: DataFrame, term: str) -> DataFrame:
    """Tables whose name holds the term, whatever the case."""
    return tables.where(F.contains(F.lower("table"), F.lit(term.lower())))


def _fk_counts(cat: Catalog) -> DataFrame:
    """(table, row_count, column_count, fks_out, referenced); self references do not count."""
    out = cat.fks.groupBy(F.col("child_table").alias("table")).agg(
        F.count(F.lit(1)).alias("fks_out"))
    parents = (cat.fks.where(F.col("child_table") != F.col("parent_table"))
               .select(F.col("parent_table").alias("table"), F.lit(True).alias("referenced"))
               .distinct())
    return cat.tables.join(out, "table", "left").join(parents, "table", "left").select(
        "table", "row_count", "column_count", F.coalesce("fks_out", F.lit(0)).alias("fks_out"),
        F.coalesce("referenced", F.lit(False)).alias("referenced"))


def table_roles(cat: Catalog, variant: str = "module") -> DataFrame:
    """isolated / junction / fact / dimension per table.

    The `app` variant knows no junction and calls a table with one reference out and none
    in `referring`.
    """
    out, referenced = F.col("fks_out"), F.col("referenced")
    lonely = (out == 0) & ~referenced
    if variant == "app":
        role = (F.when(lonely, "isolated").when(out >= 2, "fact").when(referenced, "dimension")
                .otherwise("referring"))
    else:
        role = (F.when(lonely, "isolated")
                .when((out == 2) & (F.col("column_count") <= 4), "junction")
                .when(out >= 2, "fact").otherwise("dimension"))
    return _fk_counts(cat).withColumn("role", role)


def neighbours(fks: DataFrame, table: str) -> DataFrame:
    """Tables linked to one table, in either direction."""
    ends = fks.where(F.col("child_table") == table).select(
        F.col("parent_table").alias("neighbour")).union(
        fks.where(F.col("parent_table") == table).select("child_table"))
    return ends.where(F.col("neighbour") != table).distinct()


def neighbourhood(cat: Catalog, table: str) -> DataFrame:
    """Columns of a table and its neighbours."""
    near = neighbours(cat.fks, table).select(F.col("neighbour").alias("table"))
    return cat.columns.where(F.col("table") == table).unionByName(
        cat.columns.join(near, "table", "left_semi"))


def outgoing(fks: DataFrame, table: str) -> DataFrame:
    return fks.where(F.col("child_table") == table)


def incoming(fks: DataFrame, table: str) -> DataFrame:
    return fks.where(F.col("parent_table") == table)


def in_out_degree(cat: Catalog) -> DataFrame:
    """Number of references out of and into each table."""
    out = cat.fks.groupBy(F.col("child_table").alias("table")).agg(
        F.count(F.lit(1)).alias("fks_out"))
    into = cat.fks.groupBy(F.col("parent_table").alias("table")).agg(
        F.count(F.lit(1)).alias("fks_in"))
    return cat.tables.select("table").join(out, "table", "left").join(into, "table", "left").select(
        "table", F.coalesce("fks_out", F.lit(0)).alias("fks_out"),
        F.coalesce("fks_in", F.lit(0)).alias("fks_in"))


def _fk_columns(fks: DataFrame) -> DataFrame:
    return fks.select(F.col("child_table").alias("table"), F.col("child_column").alias("column"),
                      F.lit(True).alias("is_fk")).distinct()


def weak_entities(cat: Catalog) -> DataFrame:
    """Tables with a key that consists of foreign keys only."""
    keys = cat.columns.where("primary_key").join(_fk_columns(cat.fks), list(KEY_COLUMNS), "left")
    return keys.groupBy("table").agg(
        F.count(F.lit(1)).alias("key_columns"),
        F.bool_and(F.coalesce("is_fk", F.lit(False))).alias("weak")).where("weak").drop("weak")


def participation(cat: Catalog) -> DataFrame:
    """total when the referring column is never null, else partial."""
    child = cat.columns.select(F.col("table").alias("child_table"),
                               F.col("column").alias("child_column"), "nullable")
    return cat.fks.join(child, ["child_table", "child_column"], "left").select(
        "child_table", "child_column", "parent_table", "parent_column",
        F.when(F.col("nullable") == F.lit(False), "total").otherwise("partial").alias(
            "participation"))


def columns_with_fk(cat: Catalog) -> DataFrame:
    """Columns with their first foreign-key target and whether it was inferred."""
    first = cat.fks.groupBy(F.col("child_table").alias("table"),
                            F.col("child_column").alias("column")).agg(
        F.min(F.struct("inferred", "parent_table", "parent_column")).alias("fk"))
    return cat.columns.join(first, list(KEY_COLUMNS), "left").select(
        "table", "ordinal", "column", "type", "primary_key", "nullable", "unique",
        F.concat_ws(".", "fk.parent_table", "fk.parent_column").alias("fk_target"),
        F.when(F.col("fk").isNull(), "").when(F.col("fk.inferred"), "inferred")
        .otherwise("explicit").alias("fk_kind"))


def er_edges(relations: DataFrame) -> DataFrame:
    """One diagram edge per table pair with symbol and label.

    Of parallel relationships the first by column name is shown.
    """
    # fixed values: cardinality symbols
    symbols = F.create_map(F.lit("one-to-one"), F.lit("||--||"), F.lit("one-to-many"),
                           F.lit("||--o{"), F.lit("many-to-many"), F.lit("}o--o{"),
                           F.lit("many-to-one"), F.lit("}o--||"))
    unsafe = r"[^a-zA-Z0-9_]"
    first = F.min(F.struct("from_column", "cardinality")).alias("r")
    return relations.groupBy(
        F.regexp_replace("from_table", unsafe, "_").alias("from_node"),
        F.regexp_replace("to_table", unsafe, "_").alias("to_node")).agg(first).select(
        "from_node", "to_node", F.col("r.from_column").alias("from_column"),
        F.coalesce(symbols[F.col("r.cardinality")], F.lit("||--o{")).alias("symbol"),
        F.initcap(F.replace(F.replace(F.col("r.from_column"), F.lit("_id"), F.lit("")),
                            F.lit("_"), F.lit(" "))).alias("label"))


def key_columns(cat: Catalog) -> DataFrame:
    """The columns a diagram shows: keys only, marked PK or FK."""
    return cat.columns.join(_fk_columns(cat.fks), list(KEY_COLUMNS), "left").where(
        F.col("primary_key") | F.coalesce("is_fk", F.lit(False))).select(
        "table", "ordinal", "column", F.regexp_replace("type", " ", "_").alias("type"),
        F.when(F.col("primary_key"), "PK").otherwise("FK").alias("marker"))


# --- anomalies -------------------------------------------------------------------------

def anomalies(cat: Catalog, profile: DataFrame) -> DataFrame:
    """Six structural findings as (severity, code, table, column, message).

    All-null columns are judged on the whole table, from its null profile.
    """
    t, c = F.col("table"), F.col("column")
    none = F.lit(None).cast("string")

    def finding(rows: DataFrame, severity: str, code: str, column, *message) -> DataFrame:
        return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "table",
                           column.alias("column"), F.concat(*message).alias("message"))

    columns = cat.columns
    keyed = columns.where("primary_key").select("table").distinct()
    twins = Window.partitionBy("table", F.lower("column")).orderBy("ordinal")
    loose = (columns.where(c.endswith("_id") & ~F.col("primary_key"))
             .join(_fk_columns(cat.fks), list(KEY_COLUMNS), "left_anti"))
    empty = profile.where((F.col("row_count") > 0) & (F.col("null_count") == F.col("row_count")))
    return union_all([
        finding(cat.tables.where(F.col("row_count") == 0), "warning", "EMPTY_TABLE", none,
                F.lit("table "), t, F.lit(" has 0 rows")),
        finding(cat.tables.join(keyed, "table", "left_anti"), "error", "NO_PRIMARY_KEY", none,
                F.lit("table "), t, F.lit(" has no primary key")),
        finding(columns.where(F.lower(c).isin(*AMBIGUOUS_NAMES)), "info", "AMBIGUOUS_NAME", c,
                F.lit("column "), c, F.lit(" in "), t, F.lit(" has an ambiguous name")),
        finding(columns.withColumn("nth", F.row_number().over(twins)).where("nth > 1"), "error",
                "DUPLICATE_COLUMN", c, F.lit("duplicate column "), c, F.lit(" in "), t),
        finding(loose, "warning", "ORPHAN_FK_COLUMN", c, F.lit("column "), c, F.lit(" in "), t,
                F.lit(" looks like a foreign key but has no constraint")),
        finding(empty, "warning", "ALL_NULL_COLUMN", c, F.lit("column "), c, F.lit(" in "), t,
                F.lit(" is entirely NULL")),
    ])


def schema_stats(cat: Catalog, found: DataFrame) -> DataFrame:
    """Totals of keys, foreign keys and anomalies in one row."""
    k = F.lit(1).alias("k")
    pks = cat.columns.agg(F.count_if("primary_key").alias("total_pks"), k)
    fks = cat.fks.agg(F.count(F.lit(1)).alias("total_fks"),
                      F.count_if("inferred").alias("total_inferred_fks"), k)
    odd = found.agg(F.count(F.lit(1)).alias("total_anomalies"),
                    F.count_distinct("table").alias("tables_with_anomalies"), k)
    return pks.join(fks, "k").join(odd, "k").drop("k")


# --- dictionary --------------------------------------------------------------------------

def sample_rows(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first n rows, by the given columns; each task keeps n rows at most."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n) if order_by else df.limit(n)


def sample_row_json(tables: Tables, order_by: Mapping[str, Sequence[str]], n: int = 5
                    ) -> DataFrame:
    """(table, rn, row_json): the sample rows of several tables as JSON text."""
    parts = []
    for name, df in tables.items():
        first = sample_rows(df, n, order_by[name])
        # n rows in all, so one window task is enough
        rn = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(
            *[col(c) for c in order_by[name]]))
        parts.append(first.select(F.lit(name).alias("table"), rn.alias("rn"),
                                  F.to_json(F.struct(*[col(c) for c in df.columns])).alias(
                                      "row_json")))
    return union_all(parts)


def _sample_text(field, chars: int) -> Column:
    """The sample text of a value."""
    nested = field.dataType.typeName() in ("array", "map", "struct", "variant")
    text = F.to_json(col(field.name)) if nested else col(field.name).cast("string")
    return F.substring(text, 1, chars)


def _first_values(rows: DataFrame, keys: Sequence[str], texts: Mapping[int, Column], k: int) -> DataFrame:
    """(ordinal, nth, value): the k first values of each column by the keys.

    The rank is bounded, so Spark ranks within the tasks before it shuffles: k values of a
    column leave a task, however many there are.
    """
    held = [f"k{i}" for i in range(len(keys))]
    wide = rows.select(*[col(c).alias(h) for c, h in zip(keys, held)],
                       *[text.alias(str(i)) for i, text in texts.items()])
    first = Window.partitionBy("ordinal").orderBy(*held)
    return (wide.unpivot(held, [col(str(i)) for i in texts], "ordinal", "value")
            .where(F.col("value").isNotNull())
            .withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)
            .select(F.col("ordinal").cast("int").alias("ordinal"), "nth", "value"))


def column_dictionary(cat: Catalog, tables: Tables, order_by: Mapping[str, Sequence[str]],
                      sample: int = 5, k: int = 3, chars: int = 50) -> DataFrame:
    """Per column: type, nullability, key marks, target, and up to k sample values.

    Samples are the first k non-null values of the whole table in key order, shortened.
    The first `sample` rows give them for most columns. The columns with fewer than k
    values there are read again, all in one scan, where every task keeps the k first
    values of a column. Columns are read by place, as the catalog numbers them, so names
    may repeat.
    """
    parts = []
    for name, df in tables.items():
        placed = by_place(df)
        fields = {i: f for i, f in enumerate(placed.schema.fields, start=1)
                  if f.dataType.typeName() != "binary"}
        keys = [place_of(df, c) for c in order_by[name]]
        first = sample_rows(placed, max(sample, k), keys)
        known = first.agg(*[F.count(col(f.name)).alias(f.name) for f in fields.values()]).first()
        full = [i for i, f in fields.items() if known[f.name] >= k]
        sparse = [i for i in fields if i not in full]
        parts += [_first_values(rows, keys, {i: _sample_text(fields[i], chars) for i in mine}, k)
                  .withColumn("table", F.lit(name)) for rows, mine in ((first, full), (placed, sparse)) if mine]
    picked = union_all(parts).groupBy("table", "ordinal").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("nth", "value"))), lambda s: s["value"]), " | ").alias("samples"))
    listed = columns_with_fk(cat)
    names = listed.join(cat.tables.select("table"), "table", "left_semi")
    return names.join(picked, ["table", "ordinal"], "left").select(
        "table", "ordinal", "column", "type", "nullable", "primary_key", "fk_target",
        F.coalesce("samples", F.lit("")).alias("samples"))
