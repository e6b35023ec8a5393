"""Dimensions, scores and issues on small tables."""

import pytest
from pyspark.sql import functions as F

from tablescope import ForeignKey, QualityPolicy
from tablescope.operators import issues, profile as prof, quality as q
from tablescope.plans import scorecard as cards
from tablescope.policy import EnumRule, SequenceRule

from .conftest import rows

AS_OF = "2024-03-01 12:00:00"


def dates(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "d string").selectExpr(
        "cast(d as timestamp_ntz) as d")


@pytest.mark.parametrize("newest, days, app, module", [
    ("2024-03-01 12:00:00", 0, 100.0, 100.0), ("2024-02-29 13:00:00", 0, 100.0, 100.0),
    ("2024-01-31 12:00:00", 30, 100.0, 85.0), ("2024-01-31 11:59:59", 30, 80.0, 85.0),
    ("2023-03-02 12:00:00", 365, 80.0, 50.0), ("2023-03-02 11:00:00", 365, 60.0, 50.0),
    ("2018-01-01 00:00:00", 2251, 40.0, 25.0), ("2024-03-05 13:00:00", -5, 100.0, 100.0)])
def test_ages_and_ladders(spark, newest, days, app, module):
    tables = {"t": dates(spark, newest, None, "2001-01-01 00:00:00")}
    found = q.newest_dates(tables)
    linear = q.freshness_linear(found, AS_OF).first()
    assert linear["days_ago"] == days
    assert linear["score"] == pytest.approx(max(0.0, 100 - days * 100 / 3650))
    assert linear["status"] == ("DATA_STALE" if days > 365 else "FRESH")
    counts = prof.row_counts(tables)
    assert q.freshness_ladder_app(counts, found, AS_OF).first()["freshness"] == app
    assert q.freshness_ladder_module(found, AS_OF).first()["score"] == module


def test_freshness_defaults(spark):
    tables = {"empty": dates(spark).where("false"), "undated": spark.range(3).toDF("id"),
              "hollow": dates(spark, None)}
    counts, found = prof.row_counts(tables), q.newest_dates(tables)
    assert {r["table"]: r["freshness"] for r in q.freshness_ladder_app(
        counts, found, AS_OF).collect()} == {"empty": 50.0, "undated": 80.0, "hollow": 60.0}
    stepped = q.freshness_ladder_module(found, AS_OF)
    assert {r["table"]: r["freshness"] for r in q.freshness_module_score(
        counts, stepped).collect()} == {"empty": 50.0, "undated": 80.0, "hollow": 80.0}


def test_date_columns_need_dates_in_every_value(spark):
    df = spark.createDataFrame([("2024-01-02x", "2024-01-02", None), ("x", "2024-05-06", None)],
                               "update_time string, day string, gone string")
    assert rows(q.date_columns({"t": df})) == [("t", "day", "text")]
    text = q.newest_dates({"t": df}, {"t": ["day"]}).first()
    assert str(text["newest"]).startswith("2024-05-06")


def test_tuple_keys_and_single_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (None, 5), (None, 5)], "a int, b int")
    assert rows(q.key_violations({"t": df}, {"t": ["a", "b"]}).select("key", "surplus_rows")) == [
        ("a,b", 1)]
    per_column = q.key_violations({"t": df}, {"t": ["a", "b"]}, per_column=True)
    assert rows(per_column.select("key", "duplicate_groups", "surplus_rows")) == [
        ("a", 2, 2), ("b", 2, 2)]


def test_rules_by_name_enum_and_sequence(spark):
    df = spark.sql("select 0.0D as Unit_Price, 1.2D as discount, 'x' as order_status, "
                   "timestamp_ntz'2024-01-02' as order_date, timestamp_ntz'2024-01-01' as shipped_date "
                   "union all select 1.0D, 1.0D, null, timestamp_ntz'2024-01-02', null")
    assert rows(q.domain_rules({"t": df}).select("code", "n")) == [
        ("INVALID_PRICE", 1), ("INVALID_RANGE", 1)]
    rules = [EnumRule("order_status", ("a", "b"))]
    assert q.enum_rule({"t": df}, rules).first()["n"] == 2
    kind = [EnumRule("order_status", ("a", "b"), null_is_invalid=False)]
    assert q.enum_rule({"t": df}, kind).first()["n"] == 1
    assert q.sequence_rule({"t": df}, [SequenceRule("order_date", "shipped_date")]).first()["n"] == 1
    text = df.selectExpr("cast(order_date as string) as order_date",
                         "cast(shipped_date as string) as shipped_date")
    assert q.sequence_rule({"t": text}, [SequenceRule("order_date", "shipped_date")]).first()["n"] == 1


def test_sequence_across_tables_with_a_hot_key(spark):
    child = spark.sql("select 1 as k, timestamp_ntz'2024-01-01' as shipped from range(500) union all "
                      "select 2, timestamp_ntz'2024-01-09'")
    parent = spark.sql("select 1 as id, timestamp_ntz'2024-01-05' as ordered union all "
                       "select 2, timestamp_ntz'2024-01-05'")
    got = q.sequence_violations_across(child, "shipped", "k", parent, "ordered", "id").first()
    assert got["n"] == 500


def test_scorecard_of_a_broken_an_empty_and_a_plain_table(spark):
    plain = spark.range(30).selectExpr("id", "id % 7 as group_no")
    broken = spark.sql("select cast(id % 9 as bigint) as id, case when id < 5 then null else 1.0D end "
                       "as price, timestamp_ntz'2020-01-01' as day, 'zz' as order_status from range(10)")
    tables = {"plain": plain, "broken": broken, "empty": plain.where("false")}
    fks = [ForeignKey("plain", "group_no", "broken", "id")]
    keys = {"plain": ["id"], "broken": ["id"], "empty": ["id"]}
    policy = QualityPolicy(enum_rules=(EnumRule("order_status", ("a",)),))
    card = {r["table"]: r for r in cards.scorecard6(tables, keys, fks, AS_OF, policy).collect()}
    assert card["plain"]["score"] == pytest.approx(100.0)
    assert card["broken"]["uniqueness"] == 0.0 and card["broken"]["completeness"] == 87.5
    assert card["broken"]["consistency"] == 80.0
    assert card["empty"]["score"] == pytest.approx(100 * .2 + 100 * .15)
    weights = policy.weights
    assert card["broken"]["score"] == pytest.approx(sum(card["broken"][d] * w
                                                        for d, w in weights.items()))


def test_scorecard_without_keys_and_foreign_keys(spark):
    card = cards.scorecard6({"t": spark.range(4).toDF("id")}, {}, [], AS_OF).first()
    assert (card["uniqueness"], card["fk_integrity"], card["fk_breaches"]) == (100.0, 100.0, 0)


def test_one_wide_aggregate_may_be_split(spark, monkeypatch):
    wide = spark.range(5).selectExpr("id", *[f"if(id = 0, null, id) as c{i}" for i in range(11)],
                                     "timestamp_ntz'2024-02-20 12:00:00' as d")
    whole = cards.table_measures({"t": wide}, AS_OF).first()
    monkeypatch.setattr(cards, "chunks", lambda items: [items[:4], items[4:9], items[9:]])
    assert cards.table_measures({"t": wide}, AS_OF).first() == whole
    assert whole["row_count"] == 5


def test_score4_grades_and_health(spark):
    df = spark.createDataFrame([("a", 5, 100.0, 100.0, 100.0), ("b", 5, 50.0, 60.0, 40.0),
                                ("c", 0, 0.0, 100.0, 50.0)],
                               "table string, row_count bigint, completeness double, "
                               "fk_integrity double, freshness double")
    scored = df.withColumn("score", q.score4())
    assert {r["table"]: (r["score"], r["color"], r["grade"]) for r in q.grades(scored).collect()} == {
        "a": (98.0, "green", "A"), "b": (54.0, "orange", "C"), "c": (0.0, "red", "D")}
    health = q.overall_health(scored).first()
    assert (health["overall_health"], health["overall_color"]) == (76.0, "yellow")
    none = q.overall_health(scored.where("row_count = 0")).first()
    assert none["overall_health"] == 0.0


def test_issue_limits(spark):
    profile = spark.createDataFrame(
        [("t", "a", 1, 100, 6, 6.0, 94.0, 50, 50.0), ("t", "b", 2, 100, 81, 81.0, 19.0, 2, 2.0),
         ("t", "c", 3, 100, 5, 5.0, 95.0, 1, 1.0), ("t", "d", 4, 10, 0, 0.0, 100.0, 0, 0.0)],
        "table string, column string, ordinal int, row_count bigint, null_count bigint, "
        "null_pct double, completeness double, distinct_count bigint, uniqueness double")
    report = spark.createDataFrame([("t", "a", "p", "id", 1, 95.0), ("t", "b", "p", "id", 9, 79.0)],
                                   "child_table string, child_column string, parent_table string, "
                                   "parent_column string, orphaned_count bigint, integrity_pct double")
    app = issues.issues_app(profile, report)
    assert rows(app.select("column", "code", "severity")) == [
        ("a", "FK_FAIL", "warning"), ("a", "HIGH_NULL", "warning"), ("b", "FK_FAIL", "critical"),
        ("b", "HIGH_NULL", "critical")]
    ages = spark.createDataFrame([("t", "d", 366), ("t", "c", 365)],
                                 "table string, column string, days_ago int")
    module = issues.issues_module(profile, report, ages)
    assert [(r["severity"], r["column"], r["code"]) for r in issues.ranked(module).collect()] == [
        ("critical", "b", "FK_INTEGRITY_FAILURE"), ("critical", "b", "HIGH_NULL_RATE"),
        ("warning", "a", "FK_INTEGRITY_FAILURE"), ("warning", "d", "STALE_DATA"),
        ("info", "b", "LOW_UNIQUENESS"), ("info", "c", "LOW_UNIQUENESS")]
    assert issues.top_issues(module, 2).count() == 2
    attached = {r["column"]: r["codes"] for r in issues.column_issues(profile, module).collect()}
    assert attached["b"] == "FK_INTEGRITY_FAILURE,HIGH_NULL_RATE,LOW_UNIQUENESS"
    assert attached["a"] == "FK_INTEGRITY_FAILURE"
    bands = {r["band"]: r["columns"] for r in issues.completeness_buckets(profile).collect()}
    assert bands == {"95-100%": 2, "80-95%": 1, "60-80%": 0, "40-60%": 0, "0-40%": 1}
