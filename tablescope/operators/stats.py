"""Descriptive statistics, distributions and chart data."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.exprs import (NoColumns, any_table, cast, chunks, family, literal, long_rows, measure, melt, number,
                               numeric_fields, pct, quoted, text_fields,
                               union_all, whole_days)
from .dates import Notations, date_moments
from .profile import most_frequent, text_winners, typed_frequencies
from .quantiles import fences, numeric_series, quartiles, series_fences

# wider aggregates exceed what the JVM compiles to machine code
MOMENT_COLUMNS_PER_AGGREGATE = 3
# columns on a side of a tile of the correlation matrix; a task holds a few numbers per cell
CORRELATION_TILE = 256
FENCES = ("q1", "q3", "lower_fence", "upper_fence")
OUTLIER_SCHEMA = ("table string, column string, q1 double, q3 double, lower_fence double, "
                  "upper_fence double, row_count bigint, outlier_count bigint")
BOX_PLOT_SCHEMA = ("column string, q1 double, median double, q3 double, lower_fence double, "
                   "upper_fence double, min double, max double, outlier_count bigint")
POINT_COLUMNS = (("column", "string"), ("value", "double"), ("lower_fence", "double"),
                 ("upper_fence", "double"), ("is_outlier", "boolean"))


def wide_type(field: T.StructField, value: str) -> str:
    """SQL text of a value in a type in which differences of integers don't overflow."""
    return cast(value, "decimal(20,0)") if family(field.dataType) == "integral" else value


@any_table("double")
def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, var, min, max, range, skew and kurtosis in one scan.

    The range is subtracted in the column's own type where that is exact. Skewness and excess kurtosis are corrected from the population to the sample form.
    """
    parts = []
    for chunk in chunks(numeric_fields(df, columns), MOMENT_COLUMNS_PER_AGGREGATE):
        aggs, rows = {}, []
        for i, f in enumerate(chunk):
            v, n = number(f), f"double(n{i})"
            own = v if family(f.dataType) == "fractional" else quoted(f.name)
            aggs |= {f"range{i}": f"double(max({wide_type(f, own)}) - min({wide_type(f, own)}))",
                     f"n{i}": f"count({v})", f"mean{i}": f"avg({v})", f"var{i}": f"var_samp({v})",
                     f"min{i}": f"min({v})", f"max{i}": f"max({v})", f"skew{i}": f"skewness({v})",
                     f"kurt{i}": f"kurtosis({v})"}
            rows.append({
                "column": literal(f.name), "count": f"n{i}", "mean": f"mean{i}",
                "std": f"sqrt(var{i})", "var": f"var{i}", "min": f"min{i}", "max": f"max{i}",
                "range": f"range{i}",
                "skew": f"if(n{i} >= 3, skew{i} * sqrt({n} * ({n} - 1)) / ({n} - 2), NULL)",
                "kurtosis": f"if(n{i} >= 4, ({n} - 1) / (({n} - 2) * ({n} - 3)) * "
                            f"(({n} + 1) * kurt{i} + 6), NULL)"})
        parts.append(long_rows(measure(df, aggs), rows))
    return union_all(parts)


@any_table("double")
def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None,
                  approx: bool = False) -> DataFrame:
    """Full statistics of numeric columns: moments, quartiles and mode.

    Columns without values are left out. `approx` replaces the exact quartiles.
    """
    names = [f.name for f in numeric_fields(df, columns)]
    modes = union_all([
        freq.where(F.col("value").isNotNull()).groupBy("column")
        .agg(most_frequent().cast("double").alias("mode"))
        for freq in typed_frequencies(df, names).values()])
    middle = quartiles(df, names, approx).drop("n")
    return moments(df, names).join(middle, "column").join(modes, "column")


@any_table("bigint")
def integer_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, min, max, range and mode of integral columns, exact at any size.

    `numeric_stats` gives them as doubles beside the other measures, which are whole only
    up to 2^53. The range may need one digit more than its column, so it is a decimal.
    """
    fields = [f for f in numeric_fields(df, columns) if family(f.dataType) == "integral"]
    if not fields:
        raise NoColumns("no integral column")
    parts = []
    for chunk in chunks(fields):
        aggs = {f"{fn}{i}": f"{fn}({cast(quoted(f.name), 'integral')})" for i, f in enumerate(chunk)
                for fn in ("count", "min", "max")}
        parts.append(long_rows(measure(df, aggs), [{
            "column": literal(f.name), "count": f"count{i}", "min": f"min{i}", "max": f"max{i}",
            "range": f"{wide_type(f, f'max{i}')} - {wide_type(f, f'min{i}')}"} for i, f in enumerate(chunk)]))
    modes = typed_frequencies(df, [f.name for f in fields])["integral"].where(
        F.col("value").isNotNull()).groupBy("column").agg(most_frequent().alias("mode"))
    return union_all(parts).join(modes, "column")


@any_table("double")
def basic_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """min, max and average (4 places) of numeric columns."""
    parts = []
    for chunk in chunks(numeric_fields(df, columns)):
        aggs = {f"{fn}{i}": f"{fn}({number(f)})" for i, f in enumerate(chunk)
                for fn in ("min", "max", "avg")}
        parts.append(long_rows(measure(df, aggs), [{
            "column": literal(f.name), "min": f"min{i}", "max": f"max{i}",
            "avg": f"round(avg{i}, 4)"} for i, f in enumerate(chunk)]))
    return union_all(parts)


def typed_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean over the values of text columns that read as numbers."""
    aggs = {f"{fn}{i}": f"{fn}(try_cast({quoted(c)} AS double))"
            for i, c in enumerate(columns) for fn in ("count", "avg")}
    return long_rows(measure(df, aggs), [{
        "column": literal(c), "numeric_count": f"count{i}", "mean": f"avg{i}"}
        for i, c in enumerate(columns)])


@any_table("timestamp")
def date_stats(df: DataFrame, columns: Sequence[str] | None = None,
               notations: Notations | None = None) -> DataFrame:
    """Earliest, latest, range in days, most common year and month.

    One scan groups by (column, year, month); the rest works on those few rows. Text
    columns in `notations` (see `dates.notations_of`) are read as dates, too.
    """
    dated = date_moments(df, notations, columns)
    if not dated:
        raise NoColumns("no date column")
    months = (melt(df, dated)
              .where(F.col("value").isNotNull())
              .groupBy("column", F.year("value").alias("year"), F.month("value").alias("month"))
              .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first"),
                   F.max("value").alias("last")))
    years = (months.groupBy("column", "year")
             .agg(F.sum("n").alias("n"), F.min("first").alias("first"),
                  F.max("last").alias("last"))
             .groupBy("column").agg(F.min("first").alias("earliest"),
                                    F.max("last").alias("latest"),
                                    most_frequent("year").alias("common_year")))
    common_month = (months.groupBy("column", "month").agg(F.sum("n").alias("n"))
                    .groupBy("column").agg(most_frequent("month").alias("common_month")))
    return years.join(common_month, "column").select(
        "column", "earliest", "latest",
        F.expr(whole_days("earliest", "latest")).alias("range_days"),
        "common_year", "common_month")


@any_table("string")
def text_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most and least frequent value, distinct count, and lengths in characters.

    Values are counted by digest; two bodies a column are read.
    """
    fields = text_fields(df, columns)
    if not fields:
        raise NoColumns("no text column")
    names = [f.name for f in fields]
    winners = text_winners(df, names, which=("most", "least"), include_null=False, distinct=True)
    ranks = winners.groupBy("column").agg(
        F.max(F.when(F.col("which") == "most", F.col("value"))).alias("most_frequent"),
        F.max(F.when(F.col("which") == "least", F.col("value"))).alias("least_frequent"),
        F.max(F.when(F.col("which") == "distinct", F.col("n"))).alias("distinct_count"))
    parts = []
    for chunk in chunks(fields):
        aggs = {f"{fn}{i}": f"{fn}(char_length({quoted(f.name)}))" for i, f in enumerate(chunk)
                for fn in ("avg", "min", "max")}
        parts.append(long_rows(measure(df, aggs), [{
            "column": literal(f.name), "avg_len": f"avg{i}", "min_len": f"min{i}",
            "max_len": f"max{i}"} for i, f in enumerate(chunk)]))
    return ranks.join(union_all(parts), "column")


@any_table("double")
def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Equal-width bins from minimum to maximum, empty bins included.

    The last bin is closed, so the maximum is counted. Bins span the finite values;
    where there are infinite ones, bin 0 counts the negative and bin `bins` + 1 the
    positive. Two scans whatever the number of bins: one for the bounds, one that adds
    into at most columns x (bins + 2) counters.
    """
    fields = numeric_fields(df, columns)
    parts, finite = [], "abs({}) < double('Infinity')"
    for chunk in chunks(fields):
        aggs = {f"{fn}{i}": f"{fn}(if({finite.format(number(f))}, {number(f)}, NULL))" for i, f in enumerate(chunk)
                for fn in ("min", "max")}
        parts.append(long_rows(measure(df, aggs), [{
            "column": literal(f.name), "lo": f"min{i}", "hi": f"max{i}"}
            for i, f in enumerate(chunk)]))
    bounds = union_all(parts)
    # one row per column of the table: a broadcast bounded by the schema
    points = (melt(df, {f.name: number(f) for f in fields})
              .where(F.col("value").isNotNull()).join(F.broadcast(bounds), "column"))
    share = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    infinite = F.lit(float("inf"))
    bin_no = (F.when(F.col("value") == infinite, F.lit(bins + 1))
              .when(F.col("value") == -infinite, F.lit(0))
              .when(F.col("hi") == F.col("lo"), F.lit(1))
              .otherwise(F.least(F.floor(share * bins) + 1, F.lit(bins))).cast("int"))
    counted = points.withColumn("bin", bin_no).groupBy("column", "bin").agg(
        F.count(F.lit(1)).alias("n"))
    step = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(
        (F.col("hi") - F.col("lo")) / bins)
    grid = bounds.where(F.col("lo").isNotNull()).select("column", "lo", step.alias("step"),
                         F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    beyond = counted.where((F.col("bin") == 0) | (F.col("bin") == bins + 1))
    edge = F.when(F.col("bin") == 0, -infinite).otherwise(infinite)
    return (grid.join(counted, ["column", "bin"], "left")
            .select("column", "bin",
                    (F.col("lo") + (F.col("bin") - 1) * F.col("step")).alias("bin_low"),
                    (F.col("lo") + F.col("bin") * F.col("step")).alias("bin_high"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
            .unionByName(beyond.select("column", "bin", edge.alias("bin_low"),
                                       edge.alias("bin_high"), "n")))


def fence_limits(tables: Mapping[str, DataFrame], columns: Sequence[str] | None = None,
                 multiplier: float = 1.5, approx: bool = False
                 ) -> dict[tuple[str, str], dict[str, float]]:
    """Quartiles and fences by (table, column), for columns that hold values.

    A few numbers per column of the schema, which go into the next aggregate as literals:
    counting against them needs neither a join nor a row per cell.
    """
    series = numeric_series(tables, columns)
    if not series:
        return {}
    found = series_fences(tables, dict(enumerate(series)), multiplier, approx).collect()
    return {(series[int(r["series"])].table, series[int(r["series"])].field.name): r.asDict()
            for r in found}


def outside(field: T.StructField, limits: Mapping[str, float]) -> str:
    """SQL text of the test whether a value lies beyond its fences."""
    v = number(field)
    return (f"({v} < {literal(limits['lower_fence'])} OR {v} > {literal(limits['upper_fence'])})")


def outlier_counts(tables: Mapping[str, DataFrame], columns: Sequence[str] | None = None,
                   multiplier: float = 1.5, warning_pct: float = 5.0, approx: bool = False
                   ) -> DataFrame:
    """Values beyond the fences per numeric column of several tables, as a share of all rows.

    One wide aggregate per table against the fences as literals.
    """
    limits = fence_limits(tables, columns, multiplier, approx)
    parts = []
    for name, df in tables.items():
        fields = numeric_fields(df, columns)
        for chunk in chunks([f for f in fields if (name, f.name) in limits]):
            wide = measure(df, {"n": "count(1)", **{
                f"c{i}": f"count_if({outside(f, limits[name, f.name])})" for i, f in enumerate(chunk)}})
            parts.append(long_rows(wide, [{
                "table": literal(name), "column": literal(f.name),
                **{c: literal(limits[name, f.name][c]) for c in FENCES},
                "row_count": "n", "outlier_count": f"c{i}"} for i, f in enumerate(chunk)]))
    if not parts and any(numeric_fields(df, columns) for df in tables.values()):
        spark = next(iter(tables.values())).sparkSession
        parts = [spark.createDataFrame([], OUTLIER_SCHEMA)]
    return union_all(parts).withColumn(
        "outlier_pct", pct(F.col("outlier_count"), F.col("row_count"), 0.0)).withColumn(
        "warning", F.col("outlier_pct") > warning_pct)


@any_table("double")
def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5,
                 warning_pct: float = 5.0, approx: bool = False) -> DataFrame:
    """Values beyond the fences per numeric column of one table."""
    return outlier_counts({"": df}, columns, multiplier, warning_pct, approx).drop("table")


@any_table("double")
def outlier_points(df: DataFrame, key: str, columns: Sequence[str] | None = None,
                   multiplier: float = 1.5, approx: bool = False,
                   only_outliers: bool = True) -> DataFrame:
    """Values with their fence lines and a flag; by default the outliers alone.

    The points of a row are picked from its cells before they become rows of their own.
    """
    fields = numeric_fields(df, columns)
    if not fields:
        raise NoColumns("no numeric column")
    limits = fence_limits({"": df}, columns, multiplier, approx)
    known = [f for f in fields if ("", f.name) in limits]
    cells = ", ".join(
        f"named_struct('column', {literal(f.name)}, 'value', {number(f)}, "
        f"'lower_fence', {literal(limits['', f.name]['lower_fence'])}, "
        f"'upper_fence', {literal(limits['', f.name]['upper_fence'])}, "
        f"'is_outlier', {outside(f, limits['', f.name])})" for f in known)
    if not known:
        return df.selectExpr(quoted(key), *[f"cast(NULL AS {t}) AS `{c}`" for c, t in POINT_COLUMNS]).where("false")
    points = f"array({cells})"
    if only_outliers:
        points = f"filter({points}, p -> p.is_outlier)"
    return df.selectExpr(quoted(key), f"inline({points})")


@any_table("double")
def box_plot(df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5,
             approx: bool = False) -> DataFrame:
    """Minimum, quartiles, maximum, fences and number of outlying points."""
    fields = numeric_fields(df, columns)
    if not fields:
        raise NoColumns("no numeric column")
    limits = {r["column"]: r for r in fences(df, columns, multiplier, approx).collect()}
    parts = []
    for chunk in chunks([f for f in fields if f.name in limits]):
        wide = measure(df, {name: e for i, f in enumerate(chunk) for name, e in (
            (f"lo{i}", f"min({number(f)})"), (f"hi{i}", f"max({number(f)})"),
            (f"c{i}", f"count_if({outside(f, limits[f.name])})"))})
        parts.append(long_rows(wide, [{
            "column": literal(f.name),
            **{c: literal(limits[f.name][c]) for c in ("q1", "median", "q3", "lower_fence", "upper_fence")},
            "min": f"lo{i}", "max": f"hi{i}", "outlier_count": f"c{i}"} for i, f in enumerate(chunk)]))
    return union_all(parts) if parts else df.sparkSession.createDataFrame([], BOX_PLOT_SCHEMA)


def _co_moments(df: DataFrame, left: Sequence[T.StructField], right: Sequence[T.StructField]) -> DataFrame:
    """(a, b, n, mean_a, mean_b, m_a, m_b, c): per task and pair of a left and a right
    column, over the rows where both are present, their number, means, sums of squares
    about the means and sum of products. Four products of a matrix of masks and of values
    per batch of rows; a task passes on a row per pair, not per row and pair."""
    names = [f.name for f in left] + [f.name for f in right if f not in left]
    fields = {f.name: f for f in [*left, *right]}
    at = {c: i for i, c in enumerate(names)}
    rows_, cols = [at[f.name] for f in left], [at[f.name] for f in right]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, sums = None, None
        for batch in batches:
            if not len(batch):
                continue
            mask = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if centre is None:  # any value near the mean serves: sums are moved to the means below
                with np.errstate(invalid="ignore"):
                    centre = x.sum(axis=0) / np.maximum(mask.sum(axis=0), 1)
                    centre = np.where(np.isfinite(centre), centre, 0.0)
                sums = np.zeros((6, len(rows_), len(cols)))
            with np.errstate(invalid="ignore"):
                z = np.where(mask, x - centre, 0.0)
                m = mask.astype(np.float64)
                za, zb, ma, mb = z[:, rows_], z[:, cols], m[:, rows_], m[:, cols]
                sums += [ma.T @ mb, za.T @ mb, ma.T @ zb, np.square(za).T @ mb, ma.T @ np.square(zb), za.T @ zb]
        if centre is None:
            return
        n, sa, sb, qa, qb, ab = sums
        with np.errstate(invalid="ignore"):
            some = np.maximum(n, 1)
            found = [n, sa / some + centre[rows_][:, None], sb / some + centre[cols][None, :],
                     qa - sa * sa / some, qb - sb * sb / some, ab - sa * sb / some]
        a, b = np.meshgrid(np.arange(len(rows_)), np.arange(len(cols)), indexing="ij")
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.ravel(), pa.int32()), pa.array(b.ravel(), pa.int32()),
             pa.array(found[0].ravel().astype(np.int64)), *[pa.array(v.ravel()) for v in found[1:]]],
            names=["a", "b", "n", "mean_a", "mean_b", "m_a", "m_b", "c"])

    values = df.selectExpr(*[f"{number(fields[c])} AS {quoted(f'v{i}')}" for i, c in enumerate(names)])
    return values.mapInArrow(run, "a int, b int, n long, mean_a double, mean_b double, m_a double, m_b double, c double")


@any_table("double")
def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every numeric pair, over rows where both are present.

    Long form with both orders of a pair and the diagonal; the result grows with the
    square of the columns. Each task reduces its rows to co-moments of square tiles of
    columns (one scan up to CORRELATION_TILE columns); those of all tasks are merged about
    the common mean, so large values with a small spread lose no digits.
    """
    fields = numeric_fields(df, columns)
    tiles = list(chunks(fields, CORRELATION_TILE))
    parts = []
    for i, left in enumerate(tiles):
        for right in tiles[i:]:
            moments_ = _co_moments(df, left, right)
            pair = Window.partitionBy("a", "b")
            n = F.sum("n").over(pair)
            merged = (moments_.where("n > 0")
                      .withColumn("off_a", F.col("mean_a") - F.sum(F.col("n") * F.col("mean_a")).over(pair) / n)
                      .withColumn("off_b", F.col("mean_b") - F.sum(F.col("n") * F.col("mean_b")).over(pair) / n)
                      .groupBy("a", "b").agg(
                          F.sum(F.expr("m_a + n * off_a * off_a")).alias("m_a"),
                          F.sum(F.expr("m_b + n * off_b * off_b")).alias("m_b"),
                          F.sum(F.expr("c + n * off_a * off_b")).alias("c"), F.sum("n").alias("n")))
            names = [literal([f.name for f in side]) for side in (left, right)]
            same = F.lit(left == right)
            r = F.when(same & (F.col("a") == F.col("b")), F.when(F.col("m_a") > 0, 1.0)).when(
                (F.col("m_a") > 0) & (F.col("m_b") > 0),
                F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c") / F.sqrt("m_a") / F.sqrt("m_b"))))
            grid = _pairs(df, names, len(left), len(right)).join(F.broadcast(
                merged.select("a", "b", r.alias("correlation"))), ["a", "b"], "left")
            known = grid.select("column_a", "column_b", "correlation")
            parts.append(known)
            if left != right:
                parts.append(known.select(F.col("column_b").alias("column_a"),
                                          F.col("column_a").alias("column_b"), "correlation"))
    return union_all(parts)


def _pairs(df: DataFrame, names: Sequence[str], n_left: int, n_right: int) -> DataFrame:
    """(a, b, column_a, column_b) of a tile: pairs without common rows have no moments."""
    return df.sparkSession.sql(
        f"SELECT a, b, get({names[0]}, a) AS column_a, get({names[1]}, b) AS column_b FROM "
        f"(SELECT explode(sequence(0, {n_left - 1})) AS a) CROSS JOIN "
        f"(SELECT explode(sequence(0, {n_right - 1})) AS b)")


def cardinality_bars(profile: DataFrame, line_pct: float = 5.0) -> DataFrame:
    """Cardinality share per column beside the enumeration line."""
    return profile.where(F.col("distinct_count").isNotNull()).select(
        "table", "column", F.col("uniqueness").alias("cardinality_pct"),
        F.lit(line_pct).alias("enum_line_pct"),
        (F.col("uniqueness") < line_pct).alias("below_line"))


def null_matrix(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per table, one column per table column, null percentage as cell.

    The column list is given, so no job is needed to find the pivot values.
    """
    return profile.groupBy("table").pivot("column", list(columns)).agg(F.first("null_pct"))
