"""Column profiles: row, null and distinct counts, and the value-frequency relation.

Two shapes of work cover everything here. Algebraic measures (counts, null
counts) are one wide aggregate per table. Measures that depend on equal values
(distinct, mode, rarest) come from one shuffle keyed by (column, value) after map-side
combining, so a value holding a third of the rows reaches the shuffle as one row per
task. Texts are counted by digest (`text_counts`); only the bodies of the few winners are
fetched, in a second scan (`text_winners`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.exprs import (DIGEST_BYTES, Series, by_place, cast, chunks, col, digest, family, literal,
                               long_rows, measure, melt, melt_series, named, pct, present, quoted,
                               scalar_fields, series_of, small_relation, union_all)
from ..policy import DEFAULT_POLICY, QualityPolicy
from ..session import cut_lineage

Tables = Mapping[str, DataFrame]


def row_counts(tables: Tables) -> DataFrame:
    """(table, row_count) for every table in one job."""
    return union_all([df.agg(F.count(F.lit(1)).alias("row_count"))
                     .select(F.lit(name).alias("table"), "row_count")
                      for name, df in tables.items()])


def null_profile(tables: Tables) -> DataFrame:
    """Row and null count of every column; one scan per table.

    NaN counts as missing. Columns are read by place, so names may repeat.
    """
    parts = []
    for name, df in tables.items():
        placed = by_place(df)
        fields = list(enumerate(df.schema.fields, start=1))
        for chunk in chunks(fields):
            wide = measure(placed, {"n": "count(1)", **{
                f"c{i}": f"count({present(placed.schema[i - 1])})" for i, _ in chunk}})
            parts.append(long_rows(wide, [{
                "table": literal(name), "ordinal": str(i), "column": literal(f.name),
                "type": literal(f.dataType.simpleString()), "row_count": "n",
                "null_count": f"n - c{i}"} for i, f in chunk]))
    return (union_all(parts)
            .withColumn("null_pct", pct(F.col("null_count"), F.col("row_count"), empty=0.0))
            .withColumn("completeness", F.lit(100.0) - F.col("null_pct")))


def completeness_status(profile: DataFrame, policy: QualityPolicy = DEFAULT_POLICY) -> DataFrame:
    """CRITICAL / WARNING / PASS by null percentage."""
    null_pct = F.col("null_pct")
    return profile.withColumn(
        "status", F.when(null_pct > policy.null_critical_pct, "CRITICAL")
        .when(null_pct > policy.null_warning_pct, "WARNING").otherwise("PASS"))


def completeness_score(profile: DataFrame) -> DataFrame:
    """Mean completeness of a table's columns, 0 for an empty table."""
    return profile.groupBy("table").agg(
        F.when(F.max("row_count") > 0, F.lit(100.0) - F.avg("null_pct"))
        .otherwise(F.lit(0.0)).alias("completeness"))


def typed_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """(column, value, n) per type family, values kept in their own type.

    Each family reads only its own columns, so together they read the table once.
    NULL is a value of its own here.
    """
    tables = {"": df}
    series = series_of(tables, lambda d: scalar_fields(d, columns))
    by_family: dict[str, dict[int, Series]] = {}
    for number, one in enumerate(series):
        by_family.setdefault(family(one.field.dataType), {})[number] = one
    return {
        kind: melt_series(tables, members, lambda f, kind=kind: cast(present(f), kind))
        .groupBy("series", "value").agg(F.count(F.lit(1)).alias("n"))
        .select(named(series)[1], "value", "n")
        for kind, members in by_family.items()
    }


def value_freq(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) over all scalar columns, value as text. Every value is part of the
    result, so bodies of texts travel; `text_counts` and `text_winners` do without."""
    return union_all([freq.withColumn("value", F.col("value").cast("string"))
                      for freq in typed_frequencies(df, columns).values()])


def most_frequent(value: str = "value", n: str = "n") -> Column:
    """Aggregate: the value with the highest count, smallest value among ties."""
    return F.min(F.struct((-F.col(n)).alias("rank"), F.col(value).alias("value")))["value"]


def frequency_summary(tables: Tables, approx: bool = False) -> DataFrame:
    """(table, ordinal, column, row_count, null_count, distinct_count) of every column.

    All columns of a type family, over all tables, are counted by value in one shuffle.
    Texts are counted by a digest, so no text body is shuffled whatever its length.
    Nested columns have no distinct count. `approx` swaps the value shuffle for a
    fixed-size sketch per column, at about 5 % relative error. Columns are read by place,
    so names may repeat.
    """
    placed = {name: by_place(df) for name, df in tables.items()}
    series = series_of(placed, lambda df: df.schema.fields)
    names = series_of(tables, lambda df: df.schema.fields)
    ordinals = [i for df in tables.values() for i in range(1, len(df.columns) + 1)]
    by_family: dict[str | None, dict[int, Series]] = {}
    for number, one in enumerate(series):
        by_family.setdefault(family(one.field.dataType), {})[number] = one

    def value(kind: str | None):
        if kind is None:
            return lambda f: f"if({quoted(f.name)} IS NULL, NULL, true)"
        if kind == "text":
            return lambda f: digest(cast(present(f), kind))
        return lambda f: cast(present(f), kind)

    parts = []
    for kind, members in by_family.items():
        melted = melt_series(placed, members, value(kind))
        if approx or kind is None:
            distinct = F.approx_count_distinct("value") if kind else F.lit(None).cast("bigint")
            parts.append(melted.groupBy("series").agg(
                F.count(F.lit(1)).alias("row_count"), F.count("value").alias("filled"),
                distinct.alias("distinct_count")))
            continue
        parts.append(melted.groupBy("series", "value").agg(F.count(F.lit(1)).alias("n"))
                     .groupBy("series").agg(
            F.sum("n").alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias(
                "filled"), F.count("value").alias("distinct_count")))
    return union_all(parts).select(
        *named(names), F.expr(f"{literal(ordinals)}[cast(series AS int)]").alias("ordinal"),
        "row_count", (F.col("row_count") - F.col("filled")).alias("null_count"),
        "distinct_count")


def distinct_counts(tables: Tables, approx: bool = False) -> DataFrame:
    """(table, column, distinct_count) over scalar columns."""
    return frequency_summary(tables, approx).where(F.col("distinct_count").isNotNull()).select(
        "table", "column", "distinct_count")


def schema_relation(tables: Tables) -> DataFrame:
    """(table, ordinal, column, type, scalar): the columns as declared."""
    rows = [(t, i, f.name, f.dataType.simpleString(), family(f.dataType) is not None)
            for t, df in tables.items() for i, f in enumerate(df.schema.fields, start=1)]
    return small_relation(next(iter(tables.values())).sparkSession, rows,
                          "table string, ordinal int, column string, type string, scalar boolean")


def column_profile(tables: Tables, approx: bool = False,
                   policy: QualityPolicy = DEFAULT_POLICY) -> DataFrame:
    """Null and distinct profile with status and enum flag, one row per column.

    Nested columns keep their null profile and have no distinct count.
    """
    zero = F.lit(0).cast("bigint")
    profile = (schema_relation(tables).join(frequency_summary(tables, approx),
                                            ["table", "ordinal", "column"], "left")
               # an empty table has no frequency rows: its scalar columns hold 0 values
               .select("table", "ordinal", "column", "type",
                       F.coalesce("row_count", zero).alias("row_count"),
                       F.coalesce("null_count", zero).alias("null_count"),
                       F.coalesce("distinct_count", F.when(F.col("scalar"), zero)).alias(
                           "distinct_count")))
    return finish_profile(profile, policy)


def finish_profile(counted: DataFrame, policy: QualityPolicy = DEFAULT_POLICY) -> DataFrame:
    """Shares, status and enum flag of (table, ordinal, column, type, row_count, null_count,
    distinct_count)."""
    profile = (counted
               .withColumn("null_pct", pct(F.col("null_count"), F.col("row_count"), empty=0.0))
               .withColumn("completeness", F.lit(100.0) - F.col("null_pct"))
               .withColumn("uniqueness", pct(F.col("distinct_count"), F.col("row_count"), 0.0)))
    flag = F.when((F.col("type") == "string") & (F.col("row_count") > 0)
                  & (F.col("uniqueness") < policy.enum_cardinality_pct), "POSSIBLE_ENUM")
    return completeness_status(profile, policy).withColumn("flag", flag)


def distinct_profile(tables: Tables, approx: bool = False) -> DataFrame:
    """Distinct count and its share of the rows, for scalar columns."""
    return (column_profile(tables, approx).where(F.col("distinct_count").isNotNull())
            .select("table", "column", "row_count", "distinct_count",
                    F.col("uniqueness").alias("cardinality_pct")))


def enum_candidates(profile: DataFrame) -> DataFrame:
    """Text columns whose few values suggest an enumeration."""
    return profile.where(F.col("flag") == "POSSIBLE_ENUM").select(
        "table", "column", "distinct_count", F.col("uniqueness").alias("cardinality_pct"))


def all_null_columns(profile: DataFrame) -> DataFrame:
    """Columns that hold rows but no value."""
    return profile.where((F.col("row_count") > 0) & (F.col("null_count") == F.col("row_count"))
                         ).select("table", "column", "row_count")


#: First bytes of a text that travel beside its digest, to order ties by value.
HEAD_BYTES = 16
#: Winning digests that are taken to the driver; more than that are joined by a shuffle.
COLLECTED_WINNERS = 10_000
WINNER_SCHEMA = "which string, column string, head binary, digest binary, n bigint"
RANKED_SCHEMA = "which string, column string, rank int, value string, n bigint"


def text_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, head, digest, n): how often each text occurs, texts by their first bytes
    and a digest, at most 48 bytes in all. NULL is a value of its own."""
    fields = {f.name: f for f in scalar_fields(df, columns)}
    text = {c: cast(present(f), "text") for c, f in fields.items()}
    short = melt(df, {c: f"named_struct('head', substring(cast({e} AS binary), 1, {HEAD_BYTES}), "
                         f"'digest', {digest(e)})" for c, e in text.items()})
    return short.groupBy("column", "value.head", "value.digest").agg(F.count(F.lit(1)).alias("n"))


def _fetched(df: DataFrame, columns: Sequence[str], wanted: DataFrame) -> DataFrame:
    """(column, digest, text) of the wanted (column, digest): a scan that keeps the rows
    with one of these digests and one text of each per task."""
    fields = scalar_fields(df, columns)
    long = melt(df, {f.name: cast(present(f), "text") for f in fields}).where(
        f"octet_length(value) >= {DIGEST_BYTES}").withColumn("digest", F.expr(digest("value")))
    # a set of one element: a buffer that hash aggregation takes, other than that of first()
    return long.join(wanted, ["column", "digest"]).groupBy("column", "digest").agg(
        F.collect_set("value")[0].alias("text"))


def _local(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A relation of rows that the driver holds."""
    fields = to_arrow_schema(T._parse_datatype_string(schema))
    columns = list(zip(*rows)) or [[] for _ in fields]
    return spark.createDataFrame(pa.Table.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, fields)], schema=fields))


def _first_ranks(winners: Sequence, k: int) -> list[tuple]:
    """Rows of RANKED_SCHEMA from winners whose digests are their values."""
    groups: dict[tuple[str, str], list] = {}
    for r in winners:
        digest_ = None if r["digest"] is None else bytes(r["digest"])
        groups.setdefault((r["which"], r["column"]), []).append(
            (r["n"] if r["which"] == "least" else -r["n"], digest_ is not None, digest_ or b"", r["n"]))
    return [(which, column, rank, value.decode() if some else None, n)
            for (which, column), found in groups.items()
            for rank, (_, some, value, n) in enumerate(sorted(found)[:k], start=1)]


def text_winners(df: DataFrame, columns: Sequence[str], k: int = 1, which: Sequence[str] = ("most",),
                 include_null: bool = True, distinct: bool = False) -> DataFrame:
    """(which, column, rank, value, n): the k most (`most`) or least (`least`) frequent
    texts of each column, ties to the smaller text; with `distinct` also a row `distinct`
    whose n is the number of texts.

    The first phase counts digests and keeps, per column, those of rank k or better by
    count and first bytes, with all that tie there. They are few (k a column but for texts
    that agree in count and first bytes) and come to the driver; beyond
    COLLECTED_WINNERS they stay a relation and the second phase joins them by a shuffle.
    The second phase fetches the bodies of winners that are longer than a digest.
    Runs its first phase while being called.
    """
    counts = text_counts(df, columns)
    if not include_null:
        counts = counts.where("digest IS NOT NULL")
    order = {"most": F.col("n").desc(), "least": F.col("n").asc()}
    parts = []
    for name in which:
        rank = F.rank().over(Window.partitionBy("column").orderBy(
            order[name], F.col("head").asc_nulls_first()))
        parts.append(counts.withColumn("rank", rank).where(F.col("rank") <= k).select(
            F.lit(name).alias("which"), "column", "head", "digest", "n"))
    if distinct:
        none = F.lit(None).cast("binary")
        # asks for n, so that all parts read one exchange
        parts.append(counts.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("n")).select(
            F.lit("distinct").alias("which"), "column", none.alias("head"), none.alias("digest"), "n"))
    winners = union_all(parts)
    known = winners.limit(COLLECTED_WINNERS + 1).collect()
    if len(known) > COLLECTED_WINNERS:
        winners = cut_lineage(winners)
        bodies = _fetched(df, columns, winners.where(F.octet_length("digest") == DIGEST_BYTES)
                          .select("column", "digest").distinct())
    else:
        long = sorted({(r["column"], bytes(r["digest"])) for r in known
                       if r["digest"] is not None and len(r["digest"]) == DIGEST_BYTES})
        if not long:
            return _local(df.sparkSession, _first_ranks(known, k), RANKED_SCHEMA)
        winners = _local(df.sparkSession, known, WINNER_SCHEMA)
        bodies = _fetched(df, sorted({c for c, _ in long}), F.broadcast(
            _local(df.sparkSession, long, "column string, digest binary")))
    winners = winners.join(bodies, ["column", "digest"], "left")
    value = F.coalesce(F.when(F.octet_length("digest") < DIGEST_BYTES, F.col("digest").cast("string")),
                       F.col("text"))
    nth = Window.partitionBy("which", "column").orderBy(
        F.when(F.col("which") == "least", F.col("n")).otherwise(-F.col("n")),
        F.col("value").asc_nulls_first())
    return (winners.withColumn("value", value).withColumn("rank", F.row_number().over(nth))
            .where(F.col("rank") <= k).select("which", "column", "rank", "value", "n"))


def _by_family(df: DataFrame, columns: Sequence[str] | None) -> tuple[list[str], list[str]]:
    """Names of the columns that are compared as text, and of the other scalar ones."""
    fields = scalar_fields(df, columns)
    text = [f.name for f in fields if family(f.dataType) == "text"]
    return text, [f.name for f in fields if f.name not in text]


def column_modes(df: DataFrame, columns: Sequence[str] | None = None,
                 include_null: bool = True) -> DataFrame:
    """Most frequent value of each column as text, with its count.

    With `include_null` a missing value competes like any other. Texts are won by digest.
    """
    texts, others = _by_family(df, columns)
    parts = []
    if texts:
        parts.append(text_winners(df, texts, include_null=include_null).select(
            "column", F.col("value").alias("mode"), "n"))
    for freq in typed_frequencies(df, others).values():
        if not include_null:
            freq = freq.where(F.col("value").isNotNull())
        best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value")))
        parts.append(freq.groupBy("column").agg(best.alias("best")).select(
            "column", F.col("best.value").cast("string").alias("mode"),
            (-F.col("best.rank")).alias("n")))
    return union_all(parts)


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5,
               label_chars: int = 10) -> DataFrame:
    """The k most frequent values per column with a shortened label.

    The rank filter lets Spark keep k rows per column before the shuffle. Texts are won by
    digest, and only the winners' bodies are read.
    """
    texts, others = _by_family(df, columns)
    order = Window.partitionBy("column").orderBy(F.col("n").desc(),
                                                 F.col("value").asc_nulls_first())
    parts = []
    if texts:
        parts.append(text_winners(df, texts, k).select("column", "rank", "value", "n"))
    if others:
        parts.append(value_freq(df, others).withColumn("rank", F.row_number().over(order))
                     .where(F.col("rank") <= k).select("column", "rank", "value", "n"))
    return union_all(parts).select("column", "rank", "value",
                                   F.substring("value", 1, label_chars).alias("label"), "n")


def sort_columns(profile: DataFrame, by: str = "null_pct", descending: bool = True) -> DataFrame:
    """Rows ordered by a measure, missing measures as 0, ties by table and column.

    Takes any relation with one of those, so also scores of tables.
    """
    key = F.coalesce(col(by), F.lit(0))
    ties = [c for c in ("table", "column") if c in profile.columns]
    return profile.orderBy(key.desc() if descending else key.asc(), *ties)
