"""Dates held as text: recognition, notation, and what builds on them."""

import random

import pytest

from tablescope.operators import dates, quality as q, stats
from tablescope.plans import scorecard as cards
from tablescope.policy import QualityPolicy, SequenceRule

from .conftest import rows
from .test_plans import plan_nodes

US, EU = "MM/dd/yyyy[ HH:mm[:ss]]", "dd/MM/yyyy[ HH:mm[:ss]]"


def found(df):
    return {(r["column"], r["notation"]): (r["cells"], r["readable"])
            for r in dates.text_dates({"t": df}).collect()}


def test_notation_that_reads_most_cells(spark):
    df = spark.createDataFrame(
        [("01/02/2024", "13/02/2024", "20240131", "2024-02-30"), ("02/03/2024 10:15", "01/02/2024", "20240201", "2024-02-29"),
         ("n/a", "31/12/2023 23:59:59", "", "2024-03-01T08:00:00"), (None, None, None, None)],
        "us_date string, eu_date string, date_key string, plain string")
    assert found(df) == {("us_date", US): (3, 2), ("eu_date", EU): (3, 3), ("date_key", "yyyyMMdd"): (2, 2),
                         ("plain", "ISO"): (3, 2)}


def test_what_is_no_date(spark):
    df = spark.createDataFrame(
        [("soon", "2024-01-02", "2024-01-02" + "x" * 100, 5), ("never", "x", "2024-01-03" + "y" * 100, 6)],
        "due_date string, note string, body string, time_spent int")
    assert found(df) == {}
    assert found(spark.createDataFrame([], "due_date string")) == {}
    assert found(spark.range(2)) == {}
    assert found(spark.createDataFrame([(None,), ("",)], "due_date string")) == {}


def test_odd_names_and_repeated_rows(spark):
    df = spark.createDataFrame([("2024-01-02", "1")] * 3, "`a.date``s` string, b string")
    assert found(df) == {("a.date`s", "ISO"): (3, 3)}


def test_against_plain_python(spark):
    from datetime import datetime
    rng = random.Random(4)
    cells = [rng.choice(["", None, "x", f"{rng.randint(0, 14):02d}/{rng.randint(0, 32):02d}/{rng.randint(1990, 2030)}"])
             for _ in range(500)]
    def read(form):
        got = []
        for c in cells:
            try:
                got.append(datetime.strptime(c or "", form))
            except ValueError:
                pass
        return got
    best = max([(US, "%m/%d/%Y"), (EU, "%d/%m/%Y")], key=lambda p: len(read(p[1])))
    df = spark.createDataFrame([(c,) for c in cells], "day_date string")
    assert found(df) == {("day_date", best[0]): (sum(bool(c) for c in cells), len(read(best[1])))}
    chosen = dates.notations_of(dates.text_dates({"t": df}))
    assert q.newest_dates({"t": df}, chosen).first()["newest"] == max(read(best[1]))
    got = stats.date_stats(df, notations=chosen["t"]).first()
    assert (got["earliest"], got["latest"]) == (min(read(best[1])), max(read(best[1])))


def test_scorecard_reads_text_dates(spark):
    df = spark.createDataFrame([(1, "01/10/2024", "2024-01-09"), (2, "01/20/2024", "2024-01-30"), (3, "?", "2024-02-01")],
                               "id int, order_date string, sent string")
    policy = QualityPolicy(sequence_rules=(SequenceRule("order_date", "sent"),))
    chosen = dates.notations_of(dates.text_dates({"t": df}))
    assert chosen == {"t": {"order_date": US, "sent": "ISO"}}
    blind = cards.scorecard6({"t": df}, {"t": ["id"]}, [], "2025-01-10", policy).first()
    seeing = cards.scorecard6({"t": df}, {"t": ["id"]}, [], "2025-01-10", policy, text_dates=chosen).first()
    assert blind["freshness"] == 100.0 and blind["consistency_violations"] == 0
    assert seeing["freshness"] == pytest.approx(100 - (356 + 344) / 2 / 36.5)
    assert seeing["consistency_violations"] == 1 and seeing["consistency"] == 80.0
    # 709 days: the step of five years; without a date column 80
    four = cards.scorecard4({"t": df}, [], "2026-01-10", text_dates=chosen).first()
    assert (cards.scorecard4({"t": df}, [], "2026-01-10").first()["freshness"], four["freshness"]) == (80.0, 60.0)
    assert rows(q.sequence_rule({"t": df}, policy.sequence_rules, chosen)) == [("t", "sent", "DATE_SEQUENCE_VIOLATION", 1)]


def test_recognition_shuffles_counters_only(spark):
    df = spark.createDataFrame([("2024-01-02",)] * 4, "day string").repartition(3)
    counts = dates.text_date_counts({"t": df})
    for _, name, node in plan_nodes(counts):
        if name == "Exchange" and "SinglePartition" in node.toString():
            out = node.output()
            assert {out.apply(i).dataType().typeName() for i in range(out.size())} == {"long"}
