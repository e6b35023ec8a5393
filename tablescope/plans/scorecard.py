"""Scorecards: every dimension of every table, assembled from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import chunks, literal, measure, present, union_all, whole_days
from ..operators import profile as prof, quality as q
from ..operators.dates import Notations, date_moments
from ..operators.relationships import ForeignKey, fk_integrity, table_integrity
from ..operators.stats import fence_limits, outside
from ..policy import DEFAULT_POLICY, QualityPolicy

Tables = Mapping[str, DataFrame]


def _report(tables: Tables, fks: Sequence[ForeignKey], policy: QualityPolicy) -> DataFrame | None:
    return fk_integrity(tables, fks, policy.fk_breach_pct) if fks else None


def _integrity(counts: DataFrame, report: DataFrame | None) -> DataFrame:
    if report is None:
        return counts.select("table", F.lit(100.0).alias("fk_integrity"),
                             F.lit(0).cast("bigint").alias("fk_breaches"))
    breaches = report.groupBy(F.col("child_table").alias("table")).agg(
        F.count_if("breach").alias("fk_breaches"))
    return table_integrity(report, counts).join(breaches, "table", "left").select(
        "table", "fk_integrity", F.coalesce("fk_breaches", F.lit(0)).alias("fk_breaches"))


def table_measures(tables: Tables, as_of: q.AsOf, policy: QualityPolicy = DEFAULT_POLICY,
                   limits: Mapping[tuple[str, str], Mapping[str, float]] | None = None,
                   text_dates: Mapping[str, Notations] | None = None) -> DataFrame:
    """Everything a scorecard needs that one aggregate over the table can give.

    One scan per table yields (table, row_count, completeness, freshness,
    domain_violations, consistency_violations, outlier_violations). `limits` are the
    fences of `stats.fence_limits`; without them no outlier is counted. Text columns in
    `text_dates` count as dates.
    """
    limits = limits or {}
    parts = []
    for name, df in tables.items():
        notations = (text_dates or {}).get(name, {})
        dates = date_moments(df, notations)
        domain = q.name_rule_counters(df, policy.name_rules)
        logic = [*q.sequence_counters(df, policy.sequence_rules, notations),
                 *q.enum_counters(df, policy.enum_rules)]
        rows = []
        for chunk in chunks(df.schema.fields):
            mine = {f.name for f in chunk}
            aggs = {"n": "count(1)"}
            aggs |= {f"c{i}": f"count({present(f)})" for i, f in enumerate(chunk)}
            ages = {f"d{i}": f"max({dates[f.name]})"
                    for i, f in enumerate(chunk) if f.name in dates}
            rules = {f"r{i}": f"count_if({test})" for i, (c, _, test) in enumerate(domain)
                     if c in mine}
            checks = {f"k{i}": f"count_if({test})" for i, (c, _, test) in enumerate(logic)
                      if c in mine}
            beyond = {f"o{i}": f"count_if({outside(f, limits[name, f.name])})"
                      for i, f in enumerate(chunk) if (name, f.name) in limits}
            wide = measure(df, {**aggs, **ages, **rules, **checks, **beyond})
            score = [q.linear_decay(whole_days(d, q.as_of_for(as_of, name)), policy)
                     for d in ages]
            rows.append(wide.selectExpr(
                "n AS row_count",
                _plus(f"if(n > 0, double(n - c{i}) * 100 / n, 0)" for i in range(len(chunk)))
                + " AS null_pct",
                _plus(f"coalesce({e}, double(0))" for e in score) + " AS fresh",
                _plus(f"int({d} IS NOT NULL)" for d in ages) + " AS dated",
                _plus(f"int({r} > 0)" for r in rules) + " AS domain_violations",
                _plus(f"int({k} > 0)" for k in checks) + " AS consistency_violations",
                _plus(f"int(n > 0 AND double({o}) * 100 / n > {literal(float(policy.outlier_warning_pct))})"
                      for o in beyond) + " AS outlier_violations"))
        one = union_all(rows)
        if len(rows) > 1:
            one = one.groupBy().agg(F.max("row_count").alias("row_count"), *[
                F.sum(c).alias(c) for c in one.columns if c != "row_count"])
        parts.append(one.selectExpr(
            f"{literal(name)} AS `table`", "row_count",
            f"if(row_count > 0, 100 - null_pct / {len(df.columns)}, double(0)) AS completeness",
            "if(dated > 0, fresh / dated, double(100)) AS freshness",
            "bigint(domain_violations) AS domain_violations",
            "bigint(consistency_violations) AS consistency_violations",
            "bigint(outlier_violations) AS outlier_violations"))
    return union_all(parts)


def _plus(terms) -> str:
    return " + ".join(terms) or "0"


def scorecard6(tables: Tables, keys: Mapping[str, Sequence[str]], fks: Sequence[ForeignKey],
               as_of: q.AsOf, policy: QualityPolicy = DEFAULT_POLICY,
               approx: bool = False, text_dates: Mapping[str, Notations] | None = None) -> DataFrame:
    """Six weighted dimensions, violation counts and the score; one row per table.

    `keys` names each table's primary key (a tuple is tested as a whole). `approx` swaps
    the exact quartiles behind the outlier test for sketches. `text_dates` names the text
    columns that hold dates, as `dates.notations_of` gives them.
    """
    card = table_measures(tables, as_of, policy, fence_limits(
        tables, None, policy.iqr_multiplier, approx), text_dates)
    if keys:
        broken = q.key_violations(tables, keys).groupBy("table").agg(
            F.count(F.lit(1)).alias("broken_keys"))
        card = card.join(broken, "table", "left")
    else:
        card = card.withColumn("broken_keys", F.lit(0).cast("bigint"))
    if fks:
        report = fk_integrity(tables, fks, policy.fk_breach_pct)
        links = report.groupBy(F.col("child_table").alias("table")).agg(
            F.avg("integrity_pct").alias("integrity"), F.count_if("breach").alias("breaches"))
        card = card.join(links, "table", "left")
    else:
        card = card.withColumns({"integrity": F.lit(100.0), "breaches": F.lit(0).cast("bigint")})

    def penalty(found: str, points: float) -> str:
        return (f"if(row_count = 0, double(0), greatest(double(0), double(100) - "
                f"{found} * double({points})))")

    return (card.selectExpr(
        "table", "row_count", "completeness", "freshness",
        "coalesce(broken_keys, 0) AS uniqueness_violations",
        "if(row_count = 0 OR broken_keys > 0, double(0), double(100)) AS uniqueness",
        "coalesce(integrity, double(100)) AS fk_integrity",
        "coalesce(breaches, 0) AS fk_breaches",
        "domain_violations + outlier_violations AS validity_violations",
        "consistency_violations")
        .withColumns({
            "validity": F.expr(penalty("validity_violations", policy.validity_penalty)),
            "consistency": F.expr(penalty("consistency_violations",
                                          policy.consistency_penalty))})
        .select("table", "row_count", *policy.weights, "uniqueness_violations", "fk_breaches",
                "validity_violations", "consistency_violations",
                q.weighted_score(policy.weights).alias("score")))


def scorecard4(tables: Tables, fks: Sequence[ForeignKey], as_of: q.AsOf,
               ladder: str = "app", policy: QualityPolicy = DEFAULT_POLICY,
               text_dates: Mapping[str, Notations] | None = None) -> DataFrame:
    """Completeness, integrity and step freshness plus the fixed baseline term."""
    nulls = prof.null_profile(tables)
    counts = nulls.groupBy("table").agg(F.max("row_count").alias("row_count"))
    newest = q.newest_dates(tables, text_dates)
    if ladder == "app":
        freshness = q.freshness_ladder_app(counts, newest, as_of).drop("newest")
    else:
        freshness = q.freshness_module_score(counts, q.freshness_ladder_module(newest, as_of))
    card = (counts.join(prof.completeness_score(nulls), "table")
            .join(_integrity(counts, _report(tables, fks, policy)).drop("fk_breaches"), "table")
            .join(freshness, "table"))
    return card.withColumn("score", q.score4()).withColumn("color", q.color(F.col("score")))


# --- chart data ------------------------------------------------------------------

def quality_overview(card: DataFrame) -> DataFrame:
    """Score and chart colour per table."""
    return card.select("table", "score", q.chart_color(F.col("score")).alias("color"))


def quality_radar(card: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(table, dimension, score) in long form."""
    return card.unpivot(["table"], list(dimensions), "dimension", "dimension_score")


def violation_counts(card: DataFrame) -> DataFrame:
    """(table, type, n) for the four kinds of violation, zeros included."""
    kinds = {"Uniqueness": "uniqueness_violations", "FK Breach": "fk_breaches",
             "Validity": "validity_violations", "Consistency": "consistency_violations"}
    rows = F.array(*[F.struct(F.lit(kind).alias("type"), F.col(c).cast("bigint").alias("n"))
                     for kind, c in kinds.items()])
    return card.select("table", F.inline(rows))
