"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import wraps
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Columns handled by one wide aggregate. Wider tables are split: each part reads
# only its own columns, so the bytes scanned stay the same.
COLUMNS_PER_AGGREGATE = 100


def col(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def by_place(df: DataFrame) -> DataFrame:
    """The same rows with columns named by place, `c1` first, so that columns whose names
    are equal, or differ in case alone, can be told apart."""
    return df.toDF(*[f"c{i}" for i in range(1, len(df.columns) + 1)])


def place_of(df: DataFrame, name: str) -> str:
    """The name by place of a column: the one of exactly that name, else ignoring case."""
    names = df.columns
    if name not in names:
        names, name = [c.lower() for c in names], name.lower()
    return f"c{names.index(name) + 1}"


def chunks(items: Sequence, size: int = COLUMNS_PER_AGGREGATE) -> Iterable[Sequence]:
    for start in range(0, len(items), size):
        yield items[start:start + size]


def family(data_type: T.DataType) -> str | None:
    """Type family whose members share one value column; None for nested types."""
    if isinstance(data_type, T.IntegralType):
        return "integral"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "fractional"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType, T.BooleanType,
                              T.DecimalType)):
        return "text"
    return None


FAMILY_SQL_TYPE = {
    "integral": "bigint",
    "fractional": "double",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "text": "string",
}


def scalar_fields(df: DataFrame, columns: Sequence[str] | None = None) -> list[T.StructField]:
    wanted = None if columns is None else set(columns)
    return [f for f in df.schema.fields
            if family(f.dataType) and (wanted is None or f.name in wanted)]


def numeric_fields(df: DataFrame, columns: Sequence[str] | None = None) -> list[T.StructField]:
    return [f for f in scalar_fields(df, columns) if isinstance(f.dataType, T.NumericType)]


def temporal_fields(df: DataFrame, columns: Sequence[str] | None = None) -> list[T.StructField]:
    return [f for f in scalar_fields(df, columns) if family(f.dataType) in ("date", "timestamp")]


def text_fields(df: DataFrame, columns: Sequence[str] | None = None) -> list[T.StructField]:
    return [f for f in scalar_fields(df, columns) if isinstance(f.dataType, T.StringType)]


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> str:
    """A Python value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"{value}L" if abs(value) > 2**31 - 1 else str(value)
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(literal(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def present(field: T.StructField) -> str:
    """SQL text of the value, with NaN read as missing."""
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return f"nanvl({quoted(field.name)}, NULL)"
    return quoted(field.name)


def cast(expr: str, kind: str) -> str:
    """SQL text of an expression in the value type of a family, or in a given SQL type."""
    return f"cast({expr} AS {FAMILY_SQL_TYPE.get(kind, kind)})"


#: Bytes of a digest; a shorter text stands for itself.
DIGEST_BYTES = 32


def digest(expr: str) -> str:
    """SQL text of at most 32 bytes that stand for a text of any length where values are
    only counted or compared, so that text bodies never travel: the bytes of a text of
    less than 32, else a hash of 32."""
    return (f"if(octet_length({expr}) < {DIGEST_BYTES}, cast({expr} AS binary), "
            f"unhex(sha2({expr}, 256)))")


def exact_type(types: Iterable[T.DataType]) -> str | None:
    """The SQL type that holds all values of integral and decimal types exactly: `bigint`
    if no decimal is among them, None if 38 digits are too few."""
    digits, scale, decimals = 19, 0, False
    for one in types:
        if isinstance(one, T.DecimalType):
            decimals = True
            digits, scale = max(digits, one.precision - one.scale), max(scale, one.scale)
    if not decimals:
        return "bigint"
    return f"decimal({digits + scale},{scale})" if digits + scale <= 38 else None


def plain_number(field: T.StructField) -> str:
    """SQL text of the normal form of an integral or decimal value: its sign and digits,
    without an exponent and without zeros at the end of the fraction, so that equal values
    of any two such types have equal text."""
    value = quoted(field.name)
    if not isinstance(field.dataType, T.DecimalType) or field.dataType.scale <= 0:
        return f"cast({value} AS string)"
    scale = field.dataType.scale
    return f"trim(TRAILING '.' FROM trim(TRAILING '0' FROM replace(format_number({value}, {scale}), ',', '')))"


#: Whole numbers within this are exact as bigint.
WHOLE_LIMIT = "9.2e18"


def is_whole(value: str) -> str:
    """SQL text of the test whether a number has no fraction and fits bigint."""
    return f"({value} = floor({value}) AND abs({value}) < {WHOLE_LIMIT})"


def any_table(kind: str):
    """For operators on the columns of one kind: a table without such columns gives an
    empty relation of the usual schema, taken from an empty table with a column of SQL
    type `kind`."""
    def wrap(operator):
        @wraps(operator)
        def run(df: DataFrame, *args, **options):
            try:
                return operator(df, *args, **options)
            except NoColumns:
                if "key" in options or args and isinstance(args[0], str):
                    key = options.get("key", args[0] if args else None)
                    bare = df.select(col(key)).where("false").selectExpr(
                        quoted(key), f"cast(NULL AS {kind}) AS `__none`")
                else:
                    bare = df.sparkSession.sql(f"SELECT cast(NULL AS {kind}) AS `__none` WHERE false")
                plain = {k: v for k, v in options.items() if k != "columns"}
                fixed = args[:1] if args and isinstance(args[0], str) else ()
                return operator(bare, *fixed, **plain).where(F.lit(False))
        return run
    return wrap


class NoColumns(ValueError):
    """There is no column of the wanted kind."""


def number(field: T.StructField) -> str:
    """SQL text of a numeric column as double, NaN as missing."""
    return cast(present(field), "fractional")


def measure(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    """Aggregates or projections given as SQL text, in one call."""
    return df.selectExpr(*[f"{e} AS {quoted(name)}" for name, e in exprs.items()])


def melt(df: DataFrame, exprs: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (column, value) of the named expressions, all of one type."""
    held = [quoted(k) for k in keep]
    wide = df.selectExpr(*held, *[f"{e} AS {quoted(name)}" for name, e in exprs.items()])
    return wide.unpivot(held, [quoted(name) for name in exprs], "column", "value")


class Series(NamedTuple):
    """One column of one table, known by a number while its values travel."""

    table: str
    field: T.StructField


def series_of(tables: Mapping[str, DataFrame], pick) -> list[Series]:
    """The columns `pick(df)` chooses in each table."""
    return [Series(name, f) for name, df in tables.items() for f in pick(df)]


def melt_series(tables: Mapping[str, DataFrame], series: Mapping[int, Series], value
                ) -> DataFrame:
    """(series, value) over several tables; `value(field)` is SQL text of one type.

    One relation for all tables means one shuffle for all of them, and a number is
    shorter in it than two names.
    """
    by_table: dict[str, dict[str, str]] = {}
    for number, one in series.items():
        by_table.setdefault(one.table, {})[str(number)] = value(one.field)
    return union_all([melt(tables[t], exprs) for t, exprs in by_table.items()]
                     ).withColumnRenamed("column", "series")


def named(series: Sequence[Series]) -> list[Column]:
    """Columns `table` and `column` for the numbers in column `series`."""
    names = ", ".join(f"struct({literal(s.table)}, {literal(s.field.name)})" for s in series)
    entry = f"array({names})[cast(series AS int)]"
    return [F.expr(f"{entry}.col1").alias("table"), F.expr(f"{entry}.col2").alias("column")]


def small_relation(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A relation of schema size written as literals, so its size is known when planning."""
    if not rows:
        return spark.createDataFrame([], schema)
    fields = T._parse_datatype_string(schema).fields
    names = [f"c{i}" for i in range(len(fields))]
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"cast({n} AS {f.dataType.simpleString()}) AS {quoted(f.name)}"
                      for n, f in zip(names, fields))
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS v({', '.join(names)})")


def long_rows(wide: DataFrame, rows: Sequence[Mapping[str, str]]) -> DataFrame:
    """Turn one wide row per input row into several narrow ones; cells are SQL text."""
    structs = ", ".join("named_struct(" + ", ".join(
        f"{literal(name)}, {e}" for name, e in row.items()) + ")" for row in rows)
    return wide.selectExpr(f"inline(array({structs}))")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    if not frames:
        raise NoColumns("no column of the wanted kind")
    # in halves, so that no frame is analysed again once per frame behind it
    if len(frames) == 1:
        return frames[0]
    half = len(frames) // 2
    return union_all(frames[:half]).unionByName(union_all(frames[half:]))


def pct(part: Column, whole: Column, empty: float | None = None) -> Column:
    """100 * part / whole, `empty` when there is nothing to divide by."""
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(
        F.lit(empty).cast("double"))


def ladder(value: Column, steps: Sequence[tuple[float | None, object]], at_most: bool) -> Column:
    """First step whose limit the value meets; the step without a limit is the fallback."""
    result = None
    fallback = None
    for limit, outcome in steps:
        if limit is None:
            fallback = outcome
            continue
        test = value <= limit if at_most else value >= limit
        result = F.when(test, F.lit(outcome)) if result is None else result.when(
            test, F.lit(outcome))
    return result if fallback is None else result.otherwise(F.lit(fallback))


def ntz(value: Column) -> Column:
    return value.cast("timestamp_ntz")


def whole_days(start: str, end: str) -> str:
    """SQL text of the elapsed whole days, rounded down, also when `end` is before `start`."""
    start, end = cast(start, "timestamp"), cast(end, "timestamp")

    def clock(moment: str) -> str:
        return f"({moment} - cast(cast({moment} AS date) AS timestamp_ntz))"

    return f"(datediff({end}, {start}) - if({clock(end)} < {clock(start)}, 1, 0))"


def severity_rank(severity: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in order]), severity)
