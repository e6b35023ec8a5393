"""Foreign keys: integrity, cardinality, coverage, validation.

All measures of a relationship come from one relation, `key_matches`: per key value,
how many child rows and how many parent rows hold it. Both sides are counted by
value before they meet, so a key that owns a third of the child table is one row in
the join. The counts and the join share one partitioning, (fk, value).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.exprs import (FAMILY_SQL_TYPE, exact_type, family, is_whole, melt, pct, plain_number, present,
                               small_relation, union_all)
from ..policy import FK_BREACH_PCT

Tables = Mapping[str, DataFrame]


class ForeignKey(NamedTuple):
    child_table: str
    child_column: str
    parent_table: str
    parent_column: str
    inferred: bool = False

    @property
    def label(self) -> str:
        return f"{self.child_table}.{self.child_column}>{self.parent_table}.{self.parent_column}"


FK_SCHEMA = ("child_table string, child_column string, parent_table string, "
             "parent_column string, inferred boolean")


def fk_relation(spark: SparkSession, fks: Sequence[ForeignKey]) -> DataFrame:
    """Foreign keys as a relation; its size is that of the schema."""
    return small_relation(spark, [tuple(fk) for fk in fks], FK_SCHEMA)


def fk_list(fks: DataFrame) -> list[ForeignKey]:
    """The driver-side form of a foreign-key relation (schema-sized)."""
    return [ForeignKey(r["child_table"], r["child_column"], r["parent_table"],
                       r["parent_column"], r["inferred"])
            for r in fks.select("child_table", "child_column", "parent_table", "parent_column",
                                "inferred").collect()]


def _field(df: DataFrame, name: str):
    return next(f for f in df.schema.fields if f.name == name)


#: Integers and decimals against doubles: whole numbers as the text of the integer, so
#: neighbours beyond 2^53 stay apart; fractions, and what no bigint holds, as doubles.
WHOLE = "whole"
#: Integers and decimals that no type of 38 digits holds together: by their normal form.
EXACT = "exact"


def key_value(field: T.StructField, key_type: str) -> str:
    """SQL text of a key's value in the type in which it is compared."""
    value = present(field)
    if key_type == EXACT:
        return plain_number(field)
    if key_type != WHOLE:
        return f"cast({value} AS {key_type})"
    if isinstance(field.dataType, T.IntegralType):
        return f"cast({value} AS string)"
    return (f"if({is_whole(value)}, cast(cast({value} AS bigint) AS string), "
            f"cast(cast({value} AS double) AS string))")


def _key_type(tables: Tables, fk: ForeignKey) -> str:
    """SQL type in which child and parent values are compared."""
    child = family(_field(tables[fk.child_table], fk.child_column).dataType)
    parent = family(_field(tables[fk.parent_table], fk.parent_column).dataType)
    if child is None or parent is None:
        raise ValueError(f"{fk.label}: nested columns cannot be keys")
    types = [_field(tables[t], c).dataType for t, c in (fk[:2], fk[2:4])]
    if all(isinstance(x, (T.IntegralType, T.DecimalType)) for x in types):
        return exact_type(types) or EXACT
    if child == parent:
        return FAMILY_SQL_TYPE[child]
    if "fractional" in (child, parent) and any(
            isinstance(x, (T.IntegralType, T.DecimalType)) for x in types):
        return WHOLE
    if {child, parent} == {"date", "timestamp"}:
        return "timestamp_ntz"
    return "string"


def _counted(tables: Tables, fks: Mapping[str, ForeignKey], key_type: str, side: str
             ) -> DataFrame:
    """(fk, value, n) of one side; every table is scanned once for all its keys.

    A key travels as its number, which is shorter in the shuffle than its name.
    """
    by_table: dict[str, dict[str, str]] = {}
    for number, fk in fks.items():
        table, column = ((fk.child_table, fk.child_column) if side == "child"
                         else (fk.parent_table, fk.parent_column))
        by_table.setdefault(table, {})[number] = key_value(_field(tables[table], column), key_type)
    return union_all([melt(tables[table], exprs) for table, exprs in by_table.items()]).groupBy(
        F.col("column").alias("fk"), "value").agg(F.count(F.lit(1)).alias(f"{side}_n"))


def key_matches(tables: Tables, fks: Sequence[ForeignKey]) -> DataFrame:
    """(fk, is_null, child_n, parent_n) for every key value on either side.

    `fk` is the position in `fks`, as text.
    """
    by_type: dict[str, dict[str, ForeignKey]] = {}
    for number, fk in enumerate(fks):
        by_type.setdefault(_key_type(tables, fk), {})[str(number)] = fk
    return union_all([
        _counted(tables, group, key_type, "child")
        .join(_counted(tables, group, key_type, "parent"), ["fk", "value"], "full")
        .select("fk", F.col("value").isNull().alias("is_null"), "child_n", "parent_n")
        for key_type, group in by_type.items()])


def relationship_stats(tables: Tables, fks: Sequence[ForeignKey]) -> DataFrame:
    """All measures of each foreign key, one row per key; none for no keys."""
    if not fks:
        spark = next(iter(tables.values())).sparkSession
        bare = {"t": spark.sql("SELECT cast(NULL AS bigint) AS k WHERE false")}
        return relationship_stats(bare, [ForeignKey("t", "k", "t", "k")]).where(F.lit(False))
    real = ~F.col("is_null")
    has_child, has_parent = F.col("child_n").isNotNull(), F.col("parent_n").isNotNull()
    measured = key_matches(tables, fks).groupBy("fk").agg(
        F.sum("child_n").alias("child_rows"),
        F.sum(F.when(real, F.col("child_n"))).alias("total_fk_values"),
        F.sum(F.when(real & ~has_parent, F.col("child_n"))).alias("orphaned_count"),
        F.count_if(real & has_child).alias("child_distinct"),
        F.max("child_n").alias("child_max_freq"),
        F.sum("parent_n").alias("parent_rows"),
        F.count_if(real & has_parent).alias("parent_distinct"),
        F.count_if(real & has_child & has_parent).alias("matched_distinct"))
    spark = next(iter(tables.values())).sparkSession
    known = small_relation(spark, [(str(i), *fk) for i, fk in enumerate(fks)],
                           f"fk string, {FK_SCHEMA}")
    counts = [c for c in measured.columns if c != "fk"]
    # an FK between two empty tables has no key rows at all
    return known.join(measured, "fk", "left").select(
        *FK_COLUMNS, "inferred", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


FK_COLUMNS = ("child_table", "child_column", "parent_table", "parent_column")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows with a value that no parent row holds.

    An anti join, not NOT IN: a NULL among the parents hides nothing.
    """
    fk = ForeignKey("child", column, "parent", parent_column)
    key_type = _key_type({"child": child, "parent": parent}, fk)
    keys = parent.selectExpr(f"{key_value(_field(parent, parent_column), key_type)} AS __key").where(
        F.col("__key").isNotNull())
    value = F.expr(key_value(_field(child, column), key_type))
    return child.where(value.isNotNull()).join(keys, value == F.col("__key"), "left_anti")


def orphan_count(child: DataFrame, column: str, parent: DataFrame,
                 parent_column: str) -> DataFrame:
    """Number of orphan rows; the child is counted by value first."""
    stats = relationship_stats({"child": child, "parent": parent},
                               [ForeignKey("child", column, "parent", parent_column)])
    return stats.select("orphaned_count")


def _integrity_pct() -> Column:
    total, lost = F.col("total_fk_values"), F.col("orphaned_count")
    return pct(total - lost, total, empty=100.0)


def fk_report(stats: DataFrame, breach_pct: float = FK_BREACH_PCT) -> DataFrame:
    """Integrity per foreign key, from `relationship_stats`."""
    return stats.select(*FK_COLUMNS, "total_fk_values", "orphaned_count",
                        _integrity_pct().alias("integrity_pct"), "inferred").withColumn(
        "breach", F.col("integrity_pct") < breach_pct)


def fk_integrity(tables: Tables, fks: Sequence[ForeignKey],
                 breach_pct: float = FK_BREACH_PCT) -> DataFrame:
    return fk_report(relationship_stats(tables, fks), breach_pct)


def table_integrity(report: DataFrame, names: DataFrame) -> DataFrame:
    """Mean integrity of each table's foreign keys, 100 without any."""
    scores = report.groupBy(F.col("child_table").alias("table")).agg(
        F.avg("integrity_pct").alias("fk_integrity"))
    return names.select("table").join(scores, "table", "left").select(
        "table", F.coalesce("fk_integrity", F.lit(100.0)).alias("fk_integrity"))


def average_integrity(report: DataFrame) -> DataFrame:
    """Mean integrity over all foreign keys, 100 without any."""
    return report.agg(F.coalesce(F.avg("integrity_pct"), F.lit(100.0)).alias("avg_fk_integrity"),
                      F.count(F.lit(1)).alias("fk_count"))


def cardinality(stats: DataFrame) -> DataFrame:
    """one-to-one / one-to-many / many-to-many per foreign key.

    NULL is a group of its own in the child's highest frequency but no distinct value.
    """
    empty = (F.col("child_rows") == 0) | (F.col("parent_rows") == 0)
    unique_child = ((F.col("child_distinct") == F.col("child_rows"))
                    & (F.col("child_max_freq") == 1))
    many = (F.col("parent_distinct") < F.col("parent_rows")) & (F.col("child_max_freq") > 1)
    return stats.select(
        *FK_COLUMNS, "child_rows", "child_distinct", "child_max_freq", "parent_rows",
        "parent_distinct",
        F.when(empty, "one-to-many").when(unique_child, "one-to-one")
        .when(many, "many-to-many").otherwise("one-to-many").alias("cardinality"))


def join_coverage(stats: DataFrame) -> DataFrame:
    """Distinct keys on each side and how many of them meet."""
    child, parent = F.col("child_distinct"), F.col("parent_distinct")
    matched = F.col("matched_distinct")
    return stats.select(*FK_COLUMNS, "child_distinct", "parent_distinct", "matched_distinct",
                        (child - matched).alias("child_only"),
                        (parent - matched).alias("parent_only"),
                        pct(matched, child).alias("child_coverage_pct"),
                        pct(matched, parent).alias("parent_coverage_pct"))


def check_fks(stats: DataFrame) -> DataFrame:
    """Verdict per proposed foreign key: kept when it has values and no orphan.

    Proposals whose child column holds no value are dropped.
    """
    return stats.where(F.col("total_fk_values") > 0).select(
        *FK_COLUMNS, "total_fk_values", "orphaned_count",
        (F.col("orphaned_count") == 0).alias("valid"))


def valid_fks(checked: DataFrame) -> DataFrame:
    """The proven proposals as foreign keys, marked inferred."""
    return checked.where("valid").select(*FK_COLUMNS, F.lit(True).alias("inferred"))


def failed_fks(checked: DataFrame) -> DataFrame:
    """The refuted proposals with the reason."""
    return checked.where(~F.col("valid")).select(
        *FK_COLUMNS, F.concat(F.col("orphaned_count").cast("string"),
                              F.lit(" rows without a parent")).alias("error"))
