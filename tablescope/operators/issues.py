"""Issue feeds, remediation hints and completeness bands, derived from the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import ladder, pct, severity_rank, small_relation, union_all
from ..policy import (COMPLETENESS_BANDS, FK_APP, FK_MODULE, NULL_CRITICAL_PCT, NULL_WARNING_PCT,
                      SEVERITY_ORDER, STALE_AFTER_DAYS, FkPolicy)

# --- fixed values: hint texts ---------------------------------------------------
HINT_NULLS = "Consider backfilling NULL values in critical columns."
HINT_ORPHANS = "Repair orphan records in foreign key relationships."
HINT_STALE = "Update data source; recent records are missing."
# --------------------------------------------------------------------------------

ISSUE_COLUMNS = ("severity", "code", "table", "column", "message", "value")


def _shown(value: Column) -> Column:
    """A percentage as text with two places."""
    return F.format_string("%.2f%%", value)


def null_issues(profile: DataFrame, code: str, warning_above: float,
                critical_above: float) -> DataFrame:
    rate = F.col("null_pct")
    return profile.where((F.col("row_count") > 0) & (rate > warning_above)).select(
        F.when(rate > critical_above, "critical").otherwise("warning").alias("severity"),
        F.lit(code).alias("code"), "table", "column",
        F.concat(F.lit("null rate "), _shown(rate)).alias("message"), rate.alias("value"))


def fk_issues(report: DataFrame, code: str, policy: FkPolicy) -> DataFrame:
    value = F.col("integrity_pct")
    return report.where(value < policy.warn_below).select(
        F.when(value < policy.critical_below, "critical").otherwise("warning").alias("severity"),
        F.lit(code).alias("code"), F.col("child_table").alias("table"),
        F.col("child_column").alias("column"),
        F.concat(F.lit("FK integrity "), _shown(value), F.lit(", "),
                 F.col("orphaned_count").cast("string"), F.lit(" orphaned -> "),
                 F.concat_ws(".", "parent_table", "parent_column")).alias("message"),
        value.alias("value"))


def uniqueness_issues(profile: DataFrame, below_pct: float = 5.0, min_rows: int = 10) -> DataFrame:
    value = F.col("uniqueness")
    return profile.where((value < below_pct) & (F.col("distinct_count") > 0)
                         & (F.col("row_count") > min_rows)).select(
        F.lit("info").alias("severity"), F.lit("LOW_UNIQUENESS").alias("code"), "table", "column",
        F.concat(F.lit("uniqueness "), _shown(value), F.lit(", "),
                 F.col("distinct_count").cast("string"), F.lit(" distinct")).alias("message"),
        value.alias("value"))


def stale_issues(ages: DataFrame, after_days: int = STALE_AFTER_DAYS) -> DataFrame:
    days = F.col("days_ago")
    return ages.where(days > after_days).select(
        F.lit("warning").alias("severity"), F.lit("STALE_DATA").alias("code"), "table", "column",
        F.concat(F.lit("last record "), days.cast("string"), F.lit(" days ago")).alias("message"),
        days.cast("double").alias("value"))


def issues_app(profile: DataFrame, report: DataFrame) -> DataFrame:
    """Null rates above 5 / 30 % and integrity below 99 / 90 %."""
    return union_all([null_issues(profile, "HIGH_NULL", NULL_WARNING_PCT, NULL_CRITICAL_PCT),
                      fk_issues(report, "FK_FAIL", FK_APP)])


def issues_module(profile: DataFrame, report: DataFrame, ages: DataFrame) -> DataFrame:
    """Null rates above 50 / 80 %, few distinct values, stale dates, integrity below 100 / 80 %."""
    return union_all([null_issues(profile, "HIGH_NULL_RATE", 50.0, 80.0),
                      uniqueness_issues(profile), stale_issues(ages),
                      fk_issues(report, "FK_INTEGRITY_FAILURE", FK_MODULE)])


def ranked(issues: DataFrame) -> DataFrame:
    """Most severe first, then by table, column and code."""
    return issues.orderBy(severity_rank(F.col("severity"), SEVERITY_ORDER), "table", "column",
                          "code")


def top_issues(issues: DataFrame, k: int = 10) -> DataFrame:
    """The first k issues in severity order."""
    return ranked(issues).limit(k)


def column_issues(profile: DataFrame, issues: DataFrame) -> DataFrame:
    """Every profiled column with its issue codes, joined by commas.

    The number of codes per column is bounded by the number of rules.
    """
    codes = issues.groupBy("table", "column").agg(
        F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"),
        F.count(F.lit(1)).alias("issue_count"))
    return profile.select("table", "column", "ordinal").join(
        codes, ["table", "column"], "left").select(
        "table", "column", "ordinal", F.coalesce("codes", F.lit("")).alias("codes"),
        F.coalesce("issue_count", F.lit(0)).cast("bigint").alias("issue_count"))


def remediation(scorecard: DataFrame, completeness_below: float = 90.0,
                freshness_below: float = 50.0) -> DataFrame:
    """Hints per table, from the scorecard's dimensions."""
    hints = F.array(F.when(F.col("completeness") < completeness_below, F.lit(HINT_NULLS)),
                    F.when(F.col("fk_breaches") > 0, F.lit(HINT_ORPHANS)),
                    F.when(F.col("freshness") < freshness_below, F.lit(HINT_STALE)))
    return scorecard.select("table", F.explode(F.filter(hints, lambda h: h.isNotNull())).alias(
        "suggestion"))


def heat_band(value: Column) -> Column:
    """Label of the completeness band a value falls in."""
    return ladder(value, COMPLETENESS_BANDS, at_most=False)


def completeness_buckets(profile: DataFrame) -> DataFrame:
    """Number and share of columns per completeness band, empty bands included."""
    rows = profile.where(F.col("row_count") > 0)
    counted = rows.groupBy(heat_band(F.col("completeness")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"))
    labels = [(i, label) for i, (_, label) in enumerate(COMPLETENESS_BANDS, start=1)]
    bands = small_relation(profile.sparkSession, labels, "position int, band string")
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("k"))
    n = F.coalesce("n", F.lit(0))
    return (bands.join(counted, "band", "left").withColumn("k", F.lit(1))
            .join(F.broadcast(total), "k")  # a single row by construction
            .select("position", "band", n.cast("bigint").alias("columns"),
                    pct(n, F.col("total"), 0.0).alias("share_pct")))


def sample_exposure(counts: DataFrame, k: int = 3) -> DataFrame:
    """Share of rows shown when k sample rows of every table are handed out."""
    shown, total = F.sum(F.least("row_count", F.lit(k))), F.sum("row_count")
    return counts.agg(shown.alias("sampled_rows"), total.alias("total_rows")).withColumn(
        "exposure_pct", F.round(pct(F.col("sampled_rows"), F.col("total_rows"), 0.0), 4))
