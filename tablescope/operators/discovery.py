"""Candidate keys and foreign-key discovery from the data itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.exprs import (cast, chunks, col, digest, family, is_whole, literal, long_rows, measure, melt,
                               plain_number, present, scalar_fields, union_all)
from .profile import null_profile

Tables = Mapping[str, DataFrame]

WORD_BITS = 62
MASK_COLUMNS_PER_AGGREGATE = 50


def candidate_keys(profile: DataFrame) -> DataFrame:
    """Columns that identify their rows: no null, as many values as rows."""
    return profile.where((F.col("row_count") > 0) & (F.col("null_count") == 0)
                         & (F.col("distinct_count") == F.col("row_count"))).select(
        "table", "column", "ordinal", "row_count")


def propose_primary_keys(keys: DataFrame) -> DataFrame:
    """One key per table: the candidate that stands first in the table."""
    first = F.min(F.struct("ordinal", "column")).alias("k")
    return keys.groupBy("table").agg(first).select("table", F.col("k.column").alias("column"))


def composite_keys(tables: Tables, pairs: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """Column pairs that identify their rows, among the pairs asked for.

    The pair is grouped, which combines repeated keys before the shuffle.
    """
    parts = []
    for name, wanted in pairs.items():
        df = tables[name]
        for a, b in wanted:
            both = col(a).isNotNull() & col(b).isNotNull()
            groups = df.groupBy(col(a).alias("a"), col(b).alias("b")).agg(
                F.count(F.lit(1)).alias("n"), F.count_if(~both).alias("holes"))
            parts.append(groups.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                F.count(F.lit(1)).alias("distinct_count"),
                F.coalesce(F.sum("holes"), F.lit(0)).alias("holes")).select(
                F.lit(name).alias("table"), F.lit(f"{a},{b}").alias("columns"), "row_count",
                "distinct_count", ((F.col("row_count") > 0) & (F.col("holes") == 0) & (
                    F.col("row_count") == F.col("distinct_count"))).alias("is_key")))
    return union_all(parts)


#: Numbers of integral and decimal types together: whole ones as `w`, others as text `t`.
NUMBER = "number"


def _members(tables: Tables) -> dict[str, list[tuple[str, str]]]:
    """Comparable columns by kind; floating-point values are no keys. Integers and
    decimals are of one kind, and how a value is compared depends on the value alone, so
    no column changes what is found between two others."""
    found: dict[str, list[tuple[str, str]]] = {}
    fields = [(name, f) for name, df in tables.items() for f in scalar_fields(df)]
    decimals = any(isinstance(f.dataType, T.DecimalType) for _, f in fields)
    for name, field in fields:
        kind = family(field.dataType)
        if decimals and isinstance(field.dataType, (T.IntegralType, T.DecimalType)):
            kind = NUMBER
        if kind != "fractional":
            found.setdefault(kind, []).append((name, field.name))
    return found


def _value(field: T.StructField, kind: str) -> str:
    """SQL text by which a value is compared; null for none."""
    if kind == "text":
        return digest(cast(present(field), kind))
    if kind != NUMBER:
        return cast(present(field), kind)
    value = present(field)
    if isinstance(field.dataType, T.IntegralType):
        return f"if({value} IS NULL, NULL, named_struct('w', bigint({value}), 't', string(NULL)))"
    whole = f"named_struct('w', bigint({value}), 't', string(NULL))"
    other = f"named_struct('w', bigint(NULL), 't', {plain_number(field)})"
    return f"if({value} IS NULL, NULL, if({is_whole(value)}, {whole}, {other}))"


def _bit(i: int) -> tuple[int, int]:
    return i // WORD_BITS, 1 << (i % WORD_BITS)


def _value_masks(tables: Tables, members: Sequence[tuple[str, str]], kind: str) -> DataFrame:
    """Per value, the set of columns holding it, as bit words.

    One shuffle by value with fixed-size buffers: map-side combining turns the copies
    of a hot value into one row per task, and no list of columns is ever collected.
    """
    words = (len(members) - 1) // WORD_BITS + 1
    melted = []
    for name, df in tables.items():
        mine = [(i, c) for i, (t, c) in enumerate(members) if t == name]
        if not mine:
            continue
        fields = {f.name: f for f in df.schema.fields}
        long = melt(df, {str(i): _value(fields[c], kind) for i, c in mine})
        melted.append(long.where("value IS NOT NULL").selectExpr("value", *[
            f"if(int(column) DIV {WORD_BITS} = {w}, shiftleft(1L, int(column) - "
            f"{w * WORD_BITS}), 0L) AS w{w}" for w in range(words)]))
    return union_all(melted).groupBy("value").agg(
        *[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(words)])


def column_masks(tables: Tables) -> dict[str, tuple[list[tuple[str, str]], DataFrame]]:
    """By kind, its columns and (left_id, left_distinct, masks): per column its number of
    values and the columns that hold all of them.

    For each column, AND the masks of the values it holds: the bits left standing are the
    columns that contain it. Values are never paired with each other.
    """
    found = {}
    for kind, members in _members(tables).items():
        if len(members) < 2:
            continue
        masks = _value_masks(tables, members, kind)
        words = range((len(members) - 1) // WORD_BITS + 1)
        parts = []
        for chunk in chunks(list(range(len(members))), MASK_COLUMNS_PER_AGGREGATE):
            aggs, rows = {}, []
            for i in chunk:
                word, bit = _bit(i)
                holds = f"(w{word} & {bit}L) <> 0"
                aggs[f"n{i}"] = f"count_if({holds})"
                aggs |= {f"m{i}_{w}": f"bit_and(if({holds}, w{w}, NULL))" for w in words}
                rows.append({"left_id": str(i), "left_distinct": f"n{i}", "masks": "array("
                             + ", ".join(f"m{i}_{w}" for w in words) + ")"})
            parts.append(long_rows(measure(masks, aggs), rows))
        found[kind] = members, union_all(parts)
    return found


def inclusions(tables: Tables) -> DataFrame:
    """Every pair (left, right) where all values of left occur in right."""
    return union_all([_containing(found, members, kind)
                      for kind, (members, found) in column_masks(tables).items()])


def masked_keys(tables: Tables) -> DataFrame:
    """Candidate keys among the columns that inclusions compare, as `candidate_keys` gives
    them: the number of values comes from the masks, which reads the same exchange as
    `inclusions`, and rows and nulls from one count per table."""
    nulls = null_profile(tables).where((F.col("null_count") == 0) & (F.col("row_count") > 0)).select(
        "table", "column", "ordinal", "row_count")
    counts = union_all([found.select(
        F.expr(_name(members, "left_id", "t")).alias("table"),
        F.expr(_name(members, "left_id", "c")).alias("column"), "left_distinct")
        for members, found in column_masks(tables).values()])
    return nulls.join(counts, ["table", "column"]).where(
        F.col("left_distinct") == F.col("row_count")).select("table", "column", "ordinal", "row_count")


def _name(members: Sequence[tuple[str, str]], index: str, part: str) -> str:
    """SQL text of the table (`t`) or column (`c`) of a member by its number."""
    names = ", ".join(f"named_struct('t', {literal(t)}, 'c', {literal(c)})" for t, c in members)
    return f"array({names})[{index}].{part}"


def _containing(found: DataFrame, members: Sequence[tuple[str, str]], kind: str) -> DataFrame:
    """Read the standing bits back into columns. One row per column of the schema."""
    bits = "array(" + ", ".join(
        f"named_struct('id', {i}, 'word', {_bit(i)[0]}, 'bit', {_bit(i)[1]}L)"
        for i in range(len(members))) + ")"
    return (found.where("left_distinct > 0")
            .selectExpr("left_id", "left_distinct", f"""explode(filter({bits}, b ->
                (masks[b.word] & b.bit) <> 0 AND b.id <> left_id)) AS hit""")
            .withColumn("right_id", F.col("hit.id"))
            .selectExpr(f"{literal(kind)} AS family",
                        f"{_name(members, 'left_id', 't')} AS child_table",
                        f"{_name(members, 'left_id', 'c')} AS child_column",
                        f"{_name(members, 'right_id', 't')} AS parent_table",
                        f"{_name(members, 'right_id', 'c')} AS parent_column",
                        "left_distinct AS child_distinct"))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, falling with the edit distance."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.lit(1.0) - F.levenshtein(F.lower(a), F.lower(b)) / longest


def discover_fks(tables: Tables, keys: DataFrame | None = None) -> DataFrame:
    """Inclusion dependencies into candidate keys, ranked per child column.

    `keys` is the relation of `candidate_keys`; without it the keys come from the values
    that are compared anyway, so no profile is needed. Rank 1 is the most alike in name; of
    equal names the parent the child covers best. A dense integer key is contained in
    many others by chance, so ranks are evidence for a reviewer and not a verdict.
    """
    keys = masked_keys(tables) if keys is None else keys
    parents = keys.select(F.col("table").alias("parent_table"),
                          F.col("column").alias("parent_column"),
                          F.col("row_count").alias("parent_distinct"))
    scored = (inclusions(tables).drop("family")
              .where(F.col("child_table") != F.col("parent_table"))
              .join(parents, ["parent_table", "parent_column"])
              .withColumn("similarity", name_similarity(F.col("child_column"),
                                                        F.col("parent_column")))
              .withColumn("coverage_pct", F.col("child_distinct") * F.lit(100.0)
                          / F.col("parent_distinct")))
    order = Window.partitionBy("child_table", "child_column").orderBy(
        F.col("similarity").desc(), F.col("coverage_pct").desc(), "parent_table", "parent_column")
    return scored.withColumn("rank", F.row_number().over(order)).select(
        "child_table", "child_column", "parent_table", "parent_column", "child_distinct",
        "parent_distinct", "similarity", "coverage_pct", "rank")
