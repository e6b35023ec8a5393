"""Profiles and statistics on small tables with known answers."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablescope.operators import profile as prof, quantiles as qn, stats

from .conftest import rows


def one(df, **where):
    for column, value in where.items():
        df = df.where(F.col(column) == value)
    return df.first()


def test_empty_table_has_zero_rows_and_score(spark):
    empty = spark.createDataFrame([], "a int, b string, c array<int>")
    profile = prof.column_profile({"t": empty})
    assert rows(profile.select("column", "row_count", "null_count", "distinct_count",
                               "null_pct")) == [
        ("a", 0, 0, 0, 0.0), ("b", 0, 0, 0, 0.0), ("c", 0, 0, None, 0.0)]
    assert prof.completeness_score(prof.null_profile({"t": empty})).first()["completeness"] == 0.0
    assert prof.all_null_columns(profile).count() == 0


def test_all_null_nan_and_nested_columns(spark):
    df = spark.createDataFrame([(1, float("nan"), None, [1]), (2, 1.5, None, None)],
                               "id int, x double, gone string, list array<int>")
    got = {r["column"]: r for r in prof.column_profile({"t": df}).collect()}
    assert (got["x"]["null_count"], got["x"]["distinct_count"]) == (1, 1)
    assert got["gone"]["status"] == "CRITICAL" and got["gone"]["distinct_count"] == 0
    assert got["list"]["null_count"] == 1 and got["list"]["distinct_count"] is None
    assert [r["column"] for r in prof.all_null_columns(
        prof.null_profile({"t": df})).collect()] == ["gone"]
    wide = {r["column"]: r["null_count"] for r in prof.null_profile({"t": df}).collect()}
    assert wide == {c: got[c]["null_count"] for c in wide}


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1, "x'y"), (1, None)], "`a.b` int, `it's ``q``` string")
    profile = prof.column_profile({"t'1": df})
    assert set(rows(profile.select("table", "column", "null_count"))) == {
        ("t'1", "a.b", 0), ("t'1", "it's `q`", 1)}
    assert one(prof.column_modes(df), column="a.b")["mode"] == "1"
    assert stats.moments(df).first()["column"] == "a.b"


def test_tied_modes_take_the_smallest_value(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (3, "b"), (1, "a"), (2, None)], "n int, s string")
    assert rows(prof.column_modes(df)) == [("n", "1", 2), ("s", "a", 2)]
    assert one(stats.numeric_stats(df), column="n")["mode"] == 1.0
    text = one(stats.text_stats(df), column="s")
    assert (text["most_frequent"], text["least_frequent"], text["distinct_count"]) == ("a", "a", 2)


def test_null_competes_for_the_mode_when_asked(spark):
    df = spark.createDataFrame([(None,), (None,), ("x",)], "s string")
    assert rows(prof.column_modes(df)) == [("s", None, 2)]
    assert rows(prof.column_modes(df, include_null=False)) == [("s", "x", 1)]
    assert rows(prof.top_values(df, k=1).select("value", "n")) == [(None, 2)]


def test_numeric_stats_of_one_row(spark):
    got = stats.numeric_stats(spark.createDataFrame([(4.0,)], "x double")).first()
    assert (got["count"], got["mean"], got["q1"], got["median"], got["q3"]) == (1, 4, 4, 4, 4)
    assert got["var"] is None and got["skew"] is None and got["kurtosis"] is None


def test_skew_and_kurtosis_are_sample_forms(spark):
    data = [1.0, 2.0, 2.0, 3.0, 9.0, 11.0]
    got = stats.moments(spark.createDataFrame([(v,) for v in data], "x double")).first()
    n, mean = len(data), statistics.fmean(data)
    m2, m3, m4 = (sum((v - mean) ** k for v in data) / n for k in (2, 3, 4))
    skew = m3 / m2 ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6)
    assert got["skew"] == pytest.approx(skew)
    assert got["kurtosis"] == pytest.approx(kurt)
    assert got["std"] == pytest.approx(statistics.stdev(data))


def test_histogram_keeps_every_value(spark):
    df = spark.createDataFrame([(float(v), 7) for v in range(11)] + [(None, 7)], "x double, k int")
    bins = stats.histogram(df)
    assert bins.where("column = 'x'").agg(F.sum("n")).first()[0] == 11
    assert one(bins, column="x", bin=10)["n"] == 2  # 9 and the maximum 10
    flat = bins.where("column = 'k'")
    assert one(flat, bin=1)["n"] == 12 and flat.agg(F.sum("n")).first()[0] == 12
    assert one(flat, bin=1)["bin_high"] == 8.0  # a zero range has step 1


def test_date_stats_across_midnight(spark):
    df = spark.sql("select timestamp_ntz'2024-01-31 23:00:00' as d union all "
                   "select timestamp_ntz'2024-02-02 01:00:00' union all select null")
    got = stats.date_stats(df).first()
    assert (got["range_days"], got["common_year"], got["common_month"]) == (1, 2024, 1)


def test_null_matrix_and_sorting(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    profile = prof.null_profile({"t": df})
    assert tuple(stats.null_matrix(profile, ["a", "b"]).first()) == ("t", 0.0, 50.0)
    assert [r["column"] for r in prof.sort_columns(profile).collect()] == ["b", "a"]


# --- exact quantiles ---------------------------------------------------------------

def linear(data, p):
    data = sorted(data)
    at = p * (len(data) - 1)
    low, high = data[math.floor(at)], data[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


CASES = {
    "spread": lambda r: [r.choice((-1, 1)) * 10.0 ** r.uniform(-300, 300) for _ in range(3000)],
    "hot value": lambda r: [5.0] * 1500 + [r.gauss(5, 1) for _ in range(1500)],
    "near one": lambda r: [1.0 + i * 2 ** -52 for i in range(2000)],
    "integers": lambda r: [float(r.randint(-50, 10_000)) for _ in range(3000)],
    "zero and signs": lambda r: [0.0, -0.0] * 300 + [r.uniform(-1e-5, 1e-5) for _ in range(900)],
    "heavy tail": lambda r: [r.paretovariate(0.3) for _ in range(3000)],
}


@pytest.mark.parametrize("name", CASES)
def test_narrowed_quantiles_equal_sorting(spark, name):
    data = CASES[name](random.Random(7))
    df = spark.createDataFrame([(v,) for v in data], "x double")
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = qn.quantiles(df, probs=probs, max_sorted_values=20).first()
    assert [got[f"q{i}"] for i in range(len(probs))] == [
        pytest.approx(linear(data, p), rel=1e-15) for p in probs]


def test_quantiles_of_several_columns_with_nulls(spark):
    data = [(i, None if i % 3 else float(i), None) for i in range(500)]
    df = spark.createDataFrame(data, "a int, b double, c double")
    for limit in (5, 100_000):
        got = {r["column"]: r for r in qn.quartiles(df, max_sorted_values=limit).collect()}
        assert set(got) == {"a", "b"}
        assert got["a"]["median"] == 249.5
        assert got["b"]["q1"] == linear([float(i) for i in range(0, 500, 3)], 0.25)


def test_outliers_share_counts_missing_rows(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(20), 1000]] + [(None,)] * 19, "x double")
    got = stats.iqr_outliers(df).first()
    assert (got["row_count"], got["outlier_count"], got["outlier_pct"]) == (40, 1, 2.5)
    assert rows(stats.outlier_points(df.withColumn("id", F.monotonically_increasing_id()), "id",
                                     ["x"]).select("value")) == [(1000.0,)]


def test_correlation_is_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)],
                               "a double, b double, flat double")
    got = {(r[0], r[1]): r[2] for r in stats.correlation_matrix(df).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "a"] == 1.0
    assert got["flat", "flat"] is None and got["a", "flat"] is None and len(got) == 9
