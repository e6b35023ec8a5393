"""Quality dimensions: uniqueness, freshness, validity, consistency, and their scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import (digest, Series, cast, chunks, col, family, ladder, literal, long_rows,
                               measure, melt_series, named, ntz, numeric_fields, present, quoted,
                               small_relation, temporal_fields, text_fields, union_all, whole_days)
from ..policy import (BASELINE_DIMENSION, COLOR_CUTS, DEFAULT_POLICY, GRADE_CUTS, LADDER_APP,
                      LADDER_MODULE, OVERALL_COLOR_CUTS, WEIGHTS4, EnumRule, NameRule,
                      QualityPolicy, SequenceRule)
from .dates import DATE_START, Notations, date_moments
from .stats import outlier_counts

Tables = Mapping[str, DataFrame]
Moment = datetime | str
AsOf = Moment | Mapping[str, Moment]


def as_of_for(as_of: AsOf, table: str) -> str:
    """SQL text of a table's reference time: one for all, or per table with `*` as default."""
    moment = as_of
    if isinstance(as_of, Mapping):
        moment = as_of[table] if table in as_of else as_of["*"]
    return cast(literal(str(moment)), "timestamp")


def as_of_by_table(as_of: AsOf) -> str:
    """SQL text choosing the reference time by column `table`."""
    if not isinstance(as_of, Mapping):
        return as_of_for(as_of, "")
    cases = "".join(f" WHEN {literal(t)} THEN {as_of_for(as_of, t)}" for t in as_of if t != "*")
    default = f" ELSE {as_of_for(as_of, '*')}" if "*" in as_of else ""
    return f"CASE `table`{cases}{default} END" if cases else as_of_for(as_of, "*")


# --- uniqueness --------------------------------------------------------------

def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key tuples held by more than one row, with their count. NULL is a value."""
    return (df.groupBy(*[col(k).alias(k) for k in key]).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


_GROUPS = (("duplicate_groups", "count(1)"), ("surplus_rows", "sum(n - 1)"))


def key_violations(tables: Tables, keys: Mapping[str, Sequence[str]],
                   per_column: bool = False) -> DataFrame:
    """(table, key, duplicate_groups, surplus_rows, severity) for each key that repeats.

    The whole tuple is tested; `per_column` tests each key column on its own. Keys of one
    column are counted together, one shuffle per type family for all tables.
    """
    if not any(keys.values()):
        spark = next(iter(tables.values())).sparkSession
        return small_relation(spark, [], "table string, key string, duplicate_groups bigint, "
                                         "surplus_rows bigint, severity string")
    wanted = [(t, c) for t, key in keys.items()
              for c in ([[k] for k in key] if per_column else [list(key)])]
    fields = {t: {f.name: f for f in tables[t].schema.fields} for t, _ in wanted}
    single = [Series(t, fields[t][c[0]]) for t, c in wanted if len(c) == 1]
    parts = []
    by_family: dict[str, dict[int, Series]] = {}
    for number, one in enumerate(single):
        kind = family(one.field.dataType)
        if kind is None:
            raise ValueError(f"{one.table}.{one.field.name}: nested columns cannot be keys")
        by_family.setdefault(kind, {})[number] = one
    for kind, members in by_family.items():
        value = lambda f: digest(cast(present(f), "text")) if family(
            f.dataType) == "text" else cast(present(f), family(f.dataType))
        repeated = (melt_series(tables, members, value)
                    .groupBy("series", "value").agg(F.count(F.lit(1)).alias("n"))
                    .where(F.col("n") > 1))
        table, column = named(single)
        parts.append(repeated.groupBy("series").agg(*[F.expr(e).alias(name) for name, e in _GROUPS]).select(
            table, column.alias("key"), "duplicate_groups", "surplus_rows"))
    for t, columns in wanted:
        if len(columns) > 1:
            parts.append(duplicate_keys(tables[t], columns).agg(*[F.expr(e).alias(name) for name, e in _GROUPS]).select(
                F.lit(t).alias("table"), F.lit(",".join(columns)).alias("key"),
                "duplicate_groups", "surplus_rows").where(F.col("duplicate_groups") > 0))
    return union_all(parts).withColumn("severity", F.lit("CRITICAL"))


def uniqueness_score(counts: DataFrame, violations: DataFrame) -> DataFrame:
    """100, or 0 for a table without rows or with a repeated key."""
    broken = violations.groupBy("table").agg(F.count(F.lit(1)).alias("uniqueness_violations"))
    found = F.coalesce("uniqueness_violations", F.lit(0))
    return counts.join(broken, "table", "left").select(
        "table", found.cast("bigint").alias("uniqueness_violations"),
        F.when((F.col("row_count") == 0) | (found > 0), 0.0).otherwise(100.0).alias("uniqueness"))


# --- freshness ---------------------------------------------------------------

def date_columns(tables: Tables) -> DataFrame:
    """(table, column, kind): temporal columns, and text whose every value starts like a date."""
    spark = next(iter(tables.values())).sparkSession
    typed = [(t, f.name, "type") for t, df in tables.items() for f in temporal_fields(df)]
    parts = [small_relation(spark, typed, "table string, column string, kind string")]
    for name, df in tables.items():
        for chunk in chunks(text_fields(df)):
            wide = measure(df, {f"c{i}": f"bool_and({quoted(f.name)} RLIKE {literal(DATE_START)})"
                                for i, f in enumerate(chunk)})
            parts.append(long_rows(wide, [{
                "table": literal(name), "column": literal(f.name), "kind": "'text'",
                "dated": f"c{i}"} for i, f in enumerate(chunk)]).where("dated").drop("dated"))
    return union_all(parts)


def newest_dates(tables: Tables,
                 text_dates: Mapping[str, Notations | Sequence[str]] | None = None) -> DataFrame:
    """(table, column, newest): the latest moment of each date column, one scan per table.

    Text columns named in `text_dates` are parsed before they are compared: in the notation
    given there (see `dates.notations_of`), or as Spark reads moments where only names are given.
    """
    parts = []
    for name, df in tables.items():
        chosen = (text_dates or {}).get(name, ())
        if isinstance(chosen, Mapping):
            exprs = date_moments(df, chosen)
        else:
            exprs = date_moments(df) | {c: _text_moment(c) for c in chosen}
        for chunk in chunks(list(exprs.items())):
            wide = measure(df, {f"c{i}": f"max({e})" for i, (_, e) in enumerate(chunk)})
            parts.append(long_rows(wide, [{
                "table": literal(name), "column": literal(c), "newest": f"c{i}"}
                for i, (c, _) in enumerate(chunk)]))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table string, column string, newest timestamp_ntz")
    return union_all(parts)


def with_age(newest: DataFrame, as_of: AsOf) -> DataFrame:
    """Adds days_ago, rounded down; dates after `as_of` give negative ages."""
    return newest.withColumn("days_ago", F.expr(whole_days("newest", as_of_by_table(as_of))))


def linear_decay(days: str, policy: QualityPolicy = DEFAULT_POLICY) -> str:
    """SQL text of the score that falls from 100 to 0 with age."""
    return f"greatest(double(0), double(100) - {days} * double(100) / double({policy.freshness_decay_days}))"


def freshness_linear(newest: DataFrame, as_of: AsOf,
                     policy: QualityPolicy = DEFAULT_POLICY) -> DataFrame:
    """Per date column: age, DATA_STALE / FRESH, and a score that decays with age."""
    return with_age(newest.where(F.col("newest").isNotNull()), as_of).selectExpr(
        "table", "column", "newest", "days_ago",
        f"if(days_ago > {policy.stale_after_days}, 'DATA_STALE', 'FRESH') AS status",
        f"{linear_decay('days_ago', policy)} AS score")


def freshness_score(counts: DataFrame, linear: DataFrame) -> DataFrame:
    """Mean over the table's date columns, 100 without any."""
    means = linear.groupBy("table").agg(F.avg("score").alias("freshness"))
    return counts.select("table").join(means, "table", "left").select(
        "table", F.coalesce("freshness", F.lit(100.0)).alias("freshness"))


def freshness_ladder_app(counts: DataFrame, newest: DataFrame, as_of: AsOf) -> DataFrame:
    """Step score of the newest date over all date columns of a table.

    80 without a date column, 60 when none holds a date, 50 for an empty table. The age
    may hold a part of a day, so a step ends exactly at its limit.
    """
    latest = with_age(newest.groupBy("table").agg(F.max("newest").alias("newest"),
                                                  F.lit(True).alias("dated")), as_of)
    # one day more unless the age is a whole number of days
    moment = as_of_by_table(as_of)
    part = "(newest - cast(cast(newest AS date) AS timestamp_ntz)) <> " \
           f"({moment} - cast(cast({moment} AS date) AS timestamp_ntz))"
    age = F.expr(f"days_ago + if({part}, 1, 0)")
    stepped = latest.withColumn("step", ladder(age, LADDER_APP, at_most=True))
    return counts.join(stepped, "table", "left").select(
        "table", "newest",
        F.when(F.col("row_count") == 0, 50.0).when(F.col("dated").isNull(), 80.0)
        .when(F.col("newest").isNull(), 60.0).otherwise(F.col("step")).alias("freshness"))


def freshness_ladder_module(newest: DataFrame, as_of: AsOf) -> DataFrame:
    """Step score per date column, by whole days."""
    return with_age(newest.where(F.col("newest").isNotNull()), as_of).select(
        "table", "column", "newest", "days_ago",
        ladder(F.col("days_ago"), LADDER_MODULE, at_most=True).alias("score"))


def freshness_module_score(counts: DataFrame, stepped: DataFrame) -> DataFrame:
    """Mean of the column scores; 80 without a date, 50 for an empty table."""
    means = stepped.groupBy("table").agg(F.avg("score").alias("mean"))
    return counts.join(means, "table", "left").select(
        "table", F.when(F.col("row_count") == 0, 50.0).otherwise(
            F.coalesce("mean", F.lit(80.0))).alias("freshness"))


def freshness_timeline(linear: DataFrame) -> DataFrame:
    """Newest date and status per date column."""
    return linear.select("table", "column", "newest", "status")


# --- validity and consistency --------------------------------------------------

def _text_moment(name: str) -> str:
    """Text read as a moment; unreadable text is no moment."""
    return f"cast(try_to_timestamp({quoted(name)}) AS timestamp_ntz)"


def _moment_of(df: DataFrame, name: str, notations: Notations | None = None) -> str:
    if name in (notations or {}):
        return date_moments(df, notations)[name]
    if any(f.name == name for f in text_fields(df)):
        return _text_moment(name)
    return cast(quoted(name), "timestamp")


# counters are (column, code, SQL text of a test per row)

def name_rule_counters(df: DataFrame, rules: Sequence[NameRule]) -> list[tuple[str, str, str]]:
    return [(f.name, rule.code, rule.predicate.format(c=quoted(f.name)))
            for f in numeric_fields(df) for rule in rules
            if any(token in f.name.lower() for token in rule.tokens)]


def sequence_counters(df: DataFrame, rules: Sequence[SequenceRule],
                      notations: Notations | None = None) -> list[tuple[str, str, str]]:
    names = set(df.columns)
    return [(r.later, r.code,
             f"{_moment_of(df, r.later, notations)} < {_moment_of(df, r.earlier, notations)}")
            for r in rules if {r.earlier, r.later} <= names]


def enum_counters(df: DataFrame, rules: Sequence[EnumRule]) -> list[tuple[str, str, str]]:
    """A NULL is outside the set when the rule says so."""
    return [(r.column, r.code, f"coalesce({quoted(r.column)} NOT IN ("
             + ", ".join(literal(v) for v in r.allowed) + f"), {literal(r.null_is_invalid)})")
            for r in rules if r.column in df.columns]


def _count_rules(name: str, df: DataFrame, counters) -> DataFrame | None:
    """(table, column, code, n) for the counters, all in one scan."""
    parts = []
    for chunk in chunks(counters):
        wide = measure(df, {f"c{i}": f"count_if({test})" for i, (_, _, test) in enumerate(chunk)})
        parts.append(long_rows(wide, [{
            "table": literal(name), "column": literal(column), "code": literal(code),
            "n": f"c{i}"} for i, (column, code, _) in enumerate(chunk)]))
    return union_all(parts) if parts else None


VIOLATION_SCHEMA = "table string, column string, code string, n bigint"


def _violations(tables: Tables, make) -> DataFrame:
    parts = [p for name, df in tables.items()
             for p in [_count_rules(name, df, make(name, df))] if p is not None]
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], VIOLATION_SCHEMA)
    return union_all(parts).where(F.col("n") > 0)


def domain_rules(tables: Tables, policy: QualityPolicy = DEFAULT_POLICY) -> DataFrame:
    """Rows breaking a rule that a column's name calls for (price of 0, discount over 1)."""
    return _violations(tables, lambda _, df: name_rule_counters(df, policy.name_rules))


def sequence_rule(tables: Tables, rules: Sequence[SequenceRule],
                  text_dates: Mapping[str, Notations] | None = None) -> DataFrame:
    """Rows whose later date comes before the earlier one; `text_dates` as in `newest_dates`."""
    return _violations(tables, lambda name, df: sequence_counters(
        df, rules, (text_dates or {}).get(name)))


def enum_rule(tables: Tables, rules: Sequence[EnumRule]) -> DataFrame:
    """Rows with a value outside the allowed set; NULL counts unless the rule says not."""
    return _violations(tables, lambda _, df: enum_counters(df, rules))


def consistency_violations(tables: Tables, policy: QualityPolicy = DEFAULT_POLICY) -> DataFrame:
    """Sequence and enumeration rules of a table, counted in one scan."""
    return _violations(tables, lambda _, df: [*sequence_counters(df, policy.sequence_rules),
                                              *enum_counters(df, policy.enum_rules)])


def sequence_violations_across(child: DataFrame, later: str, key: str, parent: DataFrame,
                               earlier: str, parent_key: str) -> DataFrame:
    """Child rows dated before the parent row they refer to, as one count.

    The child is first counted by (key, date): a key with very many rows shrinks to its
    distinct dates before it meets the parent.
    """
    dated = (child.where(col(key).isNotNull() & col(later).isNotNull())
             .groupBy(col(key).alias("k"), ntz(col(later)).alias("later"))
             .agg(F.count(F.lit(1)).alias("n")))
    moments = parent.select(col(parent_key).alias("k"), ntz(col(earlier)).alias("earlier"))
    return dated.join(moments, "k").where(F.col("later") < F.col("earlier")).agg(
        F.lit("DATE_SEQUENCE_VIOLATION").alias("code"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def outlier_violations(tables: Tables, policy: QualityPolicy = DEFAULT_POLICY,
                       approx: bool = False) -> DataFrame:
    """Numeric columns whose share of outliers passes the warning limit."""
    if not any(numeric_fields(df) for df in tables.values()):
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], VIOLATION_SCHEMA)
    return outlier_counts(tables, None, policy.iqr_multiplier, policy.outlier_warning_pct,
                          approx).where("warning").select(
        "table", "column", F.lit("OUTLIER_WARNING").alias("code"),
        F.col("outlier_count").alias("n"))


def penalty_score(counts: DataFrame, violations: DataFrame, penalty: float,
                  name: str) -> DataFrame:
    """100 less `penalty` per violation, at least 0; 0 for an empty table."""
    found = violations.groupBy("table").agg(F.count(F.lit(1)).alias("v"))
    lost = F.coalesce("v", F.lit(0))
    return counts.join(found, "table", "left").select(
        "table", lost.cast("bigint").alias(f"{name}_violations"),
        F.when(F.col("row_count") == 0, 0.0).otherwise(
            F.greatest(F.lit(0.0), F.lit(100.0) - lost * F.lit(penalty))).alias(name))


# --- scores --------------------------------------------------------------------

def weighted_score(weights: Mapping[str, float]) -> Column:
    """Weighted sum of the dimension columns."""
    total = None
    for name, weight in weights.items():
        term = F.col(name) * F.lit(weight)
        total = term if total is None else total + term
    return total


def score4(weights: Mapping[str, float] = WEIGHTS4,
           baseline: float = BASELINE_DIMENSION) -> Column:
    """Three dimensions plus a fixed baseline, kept within 0..100; 0 for an empty table."""
    value = (F.col("completeness") * weights["completeness"]
             + F.col("fk_integrity") * weights["fk_integrity"]
             + F.col("freshness") * weights["freshness"]
             + F.lit(baseline * weights["baseline"]))
    return F.when(F.col("row_count") == 0, 0.0).otherwise(
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), value)))


def color(score: Column) -> Column:
    return ladder(score, COLOR_CUTS, at_most=False)


def overall_color(score: Column) -> Column:
    return ladder(score, OVERALL_COLOR_CUTS, at_most=False)


def chart_color(score: Column) -> Column:
    """Colour of the overview chart: strict limits at 90 and 70."""
    return F.when(score > 90, "green").when(score > 70, "orange").otherwise("red")


def grade(score: Column) -> Column:
    return ladder(score, GRADE_CUTS, at_most=False)


def grades(scores: DataFrame) -> DataFrame:
    """Score, colour and letter per table."""
    return scores.select("table", "score", color(F.col("score")).alias("color"),
                         grade(F.col("score")).alias("grade"))


def overall_health(scores: DataFrame) -> DataFrame:
    """Mean score of the tables that hold rows, 0 when none does."""
    mean = F.coalesce(F.avg(F.when(F.col("row_count") > 0, F.col("score"))), F.lit(0.0))
    return scores.agg(mean.alias("overall_health")).withColumn(
        "overall_color", overall_color(F.col("overall_health")))
