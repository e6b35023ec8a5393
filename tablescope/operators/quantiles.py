"""Exact quantiles without ever gathering a column in one task.

`percentile` keeps every distinct value of a group in one buffer, which a large
near-unique column does not survive. Here each wanted order statistic is boxed in
a value range that is narrowed by counting scans until the range holds few values;
only those are then sorted.

* The first scan counts into logarithmic slices, so widely spread magnitudes separate
  at once; a column of few values is finished by it. Later scans cut the remaining
  range into equal slices. A double has 52 mantissa bits, so a handful of scans is
  enough for any data, and two are for most.
* Each scan is one aggregate by (column, slice): its size is bounded by the number
  of slices, never by the rows, and one hot value only raises one counter.

What reaches the driver is one row per column and order statistic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import (Series, literal, melt_series, named, number, numeric_fields,
                               series_of, small_relation, union_all)

Tables = Mapping[str, DataFrame]

QUARTILES = (0.25, 0.5, 0.75)
MAX_SORTED_VALUES = 100_000
SLICES = 65_536
LOG_STEPS = 512
BOX_SCHEMA = ("series string, box int, low double, high double, below bigint, "
              "ranks array<bigint>")


@dataclass
class _Box:
    """A value range known to hold some order statistics (0-based ranks) of a series."""

    series: int
    low: float
    high: float
    below: int
    rows: int
    ranks: list[int] = field(default_factory=list)


def values(tables: Tables, series: Mapping[int, Series]) -> DataFrame:
    """(series, value) of numeric columns as doubles."""
    return melt_series(tables, series, number)


def _log_slice(value: Column) -> Column:
    magnitude = F.least(F.greatest(F.log2(F.abs(value)), F.lit(-1075.0)), F.lit(1025.0))
    return (F.when(value == 0, F.lit(0))
            .otherwise(F.floor(F.signum(value) * (magnitude + F.lit(1076.0)) * LOG_STEPS))
            .cast("bigint"))


def _even_slice(value: Column, low: Column, high: Column) -> Column:
    share = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
    return F.least(F.floor(share * SLICES), F.lit(SLICES - 1)).cast("bigint")


def _box_frame(tables: Tables, boxes: Sequence[_Box]) -> DataFrame:
    """One row per open box: at most columns times wanted ranks, so it is broadcast."""
    spark = next(iter(tables.values())).sparkSession
    return F.broadcast(small_relation(spark, [
        (str(b.series), i, b.low, b.high, b.below, b.ranks) for i, b in enumerate(boxes)],
        BOX_SCHEMA))


def _in_boxes(tables: Tables, series: Mapping[int, Series], boxes: Sequence[_Box]) -> DataFrame:
    """(box, value, low, high) of the rows that fall inside a box."""
    frame = F.broadcast(_box_frame(tables, boxes).select("series", "box", "low", "high"))
    wanted = {b.series: series[b.series] for b in boxes}
    return values(tables, wanted).join(frame, "series").where(
        F.col("value").between(F.col("low"), F.col("high")))


def _running(group: str, order: str):
    return Window.partitionBy(group).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)


def _holding(slices: DataFrame, group: str, below: Column) -> list:
    """The slices that hold a wanted rank, with `from` rows before them.

    A group has a bounded number of slices, so the running sum is bounded too.
    """
    upto = below + F.sum("rows").over(_running(group, "piece"))
    return (slices.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("rows"))
            .withColumn("held", F.filter("ranks", lambda r: (r >= F.col("from"))
                                         & (r < F.col("upto"))))
            .where(F.size("held") > 0)).collect()


def _counted(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group, "piece").agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("slice_low"),
        F.max("value").alias("slice_high"))


def _first_boxes(tables: Tables, series: Mapping[int, Series], probs: Sequence[float]
                 ) -> tuple[dict[int, int], list[_Box]]:
    """Rows per series and the boxes of the wanted ranks, from one scan."""
    value = F.col("value")
    slices = _counted(values(tables, series).where(value.isNotNull()).withColumn(
        "piece", _log_slice(value)), "series")
    n = F.sum("rows").over(Window.partitionBy("series"))
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.expr(f"array(bigint(floor({literal(float(p))} * (n - 1))), "
               f"bigint(ceil({literal(float(p))} * (n - 1))))") for p in probs])))
    hits = _holding(slices.withColumn("n", n).withColumn("ranks", ranks), "series",
                    F.lit(0).cast("bigint"))
    return ({int(r["series"]): r["n"] for r in hits},
            [_Box(int(r["series"]), r["slice_low"], r["slice_high"], r["from"], r["rows"],
                  list(r["held"])) for r in hits])


def _narrow(tables: Tables, series: Mapping[int, Series], boxes: Sequence[_Box]) -> list[_Box]:
    """Replace each box by the even slices of it that hold its ranks."""
    piece = _even_slice(F.col("value"), F.col("low"), F.col("high"))
    slices = _counted(_in_boxes(tables, series, boxes).withColumn("piece", piece), "box").join(
        _box_frame(tables, boxes), "box")
    return [_Box(int(r["series"]), r["slice_low"], r["slice_high"], r["from"], r["rows"],
                 list(r["held"])) for r in _holding(slices, "box", F.col("below"))]


def _rank_values(tables: Tables, series: Mapping[int, Series], boxes: Sequence[_Box]
                 ) -> DataFrame:
    """(series, rank, value) for the ranks of boxes narrow enough to sort.

    A box of a single value is its own answer. In the others values are counted before
    anything is sorted.
    """
    spark = next(iter(tables.values())).sparkSession
    settled = [(str(b.series), r, b.low) for b in boxes if b.low == b.high for r in b.ranks]
    parts = [small_relation(spark, settled, "series string, rank bigint, value double")]
    open_boxes = [b for b in boxes if b.low != b.high]
    if open_boxes:
        counts = _in_boxes(tables, series, open_boxes).groupBy("box", "value").agg(
            F.count(F.lit(1)).alias("n"))
        upto = F.col("below") + F.col("seen")
        parts.append(counts.withColumn("seen", F.sum("n").over(_running("box", "value")))
                     .join(_box_frame(tables, open_boxes), "box")
                     .select("series", F.explode(F.filter(
                         "ranks", lambda r: (r >= upto - F.col("n")) & (r < upto))).alias("rank"),
                         "value"))
    return union_all(parts)


def series_quantiles(tables: Tables, series: Mapping[int, Series],
                     probs: Sequence[float] = QUARTILES, approx: bool = False,
                     max_sorted_values: int = MAX_SORTED_VALUES) -> DataFrame:
    """(series, n, q0, q1, ...): linearly interpolated quantiles of numeric series.

    Exact by default; builds its boxes with small jobs while being called. `approx` uses
    one `percentile_approx` aggregate instead. Series without values give no row.
    """
    names = [f"q{i}" for i in range(len(probs))]
    if approx:
        sketch = values(tables, series).where(F.col("value").isNotNull()).groupBy("series").agg(
            F.count("value").alias("n"), F.percentile_approx("value", list(probs)).alias("q"))
        return sketch.select("series", "n", *[F.col("q")[i].alias(q) for i, q in
                                              enumerate(names)])
    sizes, large = _first_boxes(tables, series, probs)
    ready: list[_Box] = []
    while True:
        ready += [b for b in large if b.rows <= max_sorted_values or b.low == b.high]
        large = [b for b in large if b.rows > max_sorted_values and b.low != b.high]
        if not large:
            break
        large = _narrow(tables, series, large)
    spark = next(iter(tables.values())).sparkSession
    plan = small_relation(spark, [(str(i), n) for i, n in sorted(sizes.items())],
                          "series string, n bigint")
    # at most two ranks per probability: the map stays tiny
    found = _rank_values(tables, series, ready).groupBy("series").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    def at(p: float) -> str:
        place = f"{literal(float(p))} * (n - 1)"
        low, high = f"at[bigint(floor({place}))]", f"at[bigint(ceil({place}))]"
        return f"{low} + ({high} - {low}) * ({place} - floor({place}))"

    return found.join(F.broadcast(plan), "series").selectExpr(
        "series", "n", *[f"{at(p)} AS {q}" for p, q in zip(probs, names)])


def numeric_series(tables: Tables, columns: Sequence[str] | None = None) -> list[Series]:
    return series_of(tables, lambda df: numeric_fields(df, columns))


def quantiles(df: DataFrame, columns: Sequence[str] | None = None,
              probs: Sequence[float] = QUARTILES, approx: bool = False,
              max_sorted_values: int = MAX_SORTED_VALUES) -> DataFrame:
    """(column, n, q0, q1, ...) of the numeric columns of one table."""
    tables = {"": df}
    series = numeric_series(tables, columns)
    found = series_quantiles(tables, dict(enumerate(series)), probs, approx, max_sorted_values)
    return found.select(named(series)[1], "n", *[f"q{i}" for i in range(len(probs))])


def quartiles(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False,
              max_sorted_values: int = MAX_SORTED_VALUES) -> DataFrame:
    """(column, n, q1, median, q3, iqr)."""
    return quantiles(df, columns, QUARTILES, approx, max_sorted_values).select(
        "column", "n", F.col("q0").alias("q1"), F.col("q1").alias("median"),
        F.col("q2").alias("q3"), (F.col("q2") - F.col("q0")).alias("iqr"))


def _limits(multiplier: float) -> list[Column]:
    reach = F.lit(multiplier) * (F.col("q3") - F.col("q1"))
    return [(F.col("q1") - reach).alias("lower_fence"), (F.col("q3") + reach).alias("upper_fence")]


def fences(df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5,
           approx: bool = False) -> DataFrame:
    """Quartiles plus the two outlier limits."""
    return quartiles(df, columns, approx).select("*", *_limits(multiplier))


def series_fences(tables: Tables, series: Mapping[int, Series], multiplier: float = 1.5,
                  approx: bool = False) -> DataFrame:
    """(series, q1, q3, lower_fence, upper_fence); one row per series."""
    return series_quantiles(tables, series, (0.25, 0.75), approx).select(
        "series", F.col("q0").alias("q1"), F.col("q1").alias("q3")).select(
        "*", *_limits(multiplier))
