"""Column types of text data, and loading with the types found.

Every rule looks at all values of a column, so the answer does not depend on which
rows happen to come first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import (NoColumns, any_table, chunks, literal, long_rows, measure, melt, quoted, small_relation,
                               text_fields, union_all)

# --- fixed values: patterns and shares -------------------------------------------
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
PLAIN_INTEGER = r"^-?\d+$"
PLAIN_DECIMAL = r"^-?\d+\.?\d*$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}"
SLASH_DATE = r"^\d{2}/\d{2}/\d{4}"
ISO_MOMENT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
RECENT_MONTH = r"^20\d{2}-\d{2}"
BOOLEAN_WORDS = ("0", "1", "true", "false")
DATE_SHARE = 0.8
# ----------------------------------------------------------------------------------

MODES = ("strict", "sample5", "regex100")
COLUMNS_PER_AGGREGATE = 20

# type found -> SQL type used to load it
SQL_TYPES = {"INTEGER": "bigint", "REAL": "double", "BOOLEAN": "boolean",
             "DATETIME": "timestamp_ntz", "TEXT": "string", "VARCHAR(255)": "string"}
MOMENT_FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
                  "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MM/dd/yyyy")


def _value(name: str) -> str:
    """SQL text of a cell; an empty cell is missing."""
    return f"nullif({quoted(name)}, '')"


def _like(value: str, pattern: str) -> str:
    return f"({value} RLIKE {literal(pattern)})"


def _number(value: str) -> str:
    return f"try_cast(if({_like(value, NUMBER)}, trim({value}), NULL) AS double)"


def _kind(mode: str) -> str:
    """SQL text of the class of one cell; each cell is tested until a test holds."""
    v = "value"
    if mode == "strict":
        whole = f"double(trim({v})) = floor(double(trim({v})))"
        return (f"CASE WHEN {_like(v, NUMBER)} THEN if({whole}, 'whole', 'real') "
                f"WHEN {_like(v, ISO_MOMENT)} THEN 'moment' WHEN {_like(v, ISO_DATE)} THEN 'date' "
                f"WHEN {_like(v, SLASH_DATE)} THEN 'slash' ELSE 'text' END")
    if mode == "regex100":
        return (f"CASE WHEN {_like(v, PLAIN_INTEGER)} THEN 'whole' "
                f"WHEN {_like(v, PLAIN_DECIMAL)} THEN 'real' "
                f"WHEN {_like(v, ISO_DATE)} THEN 'date' ELSE 'text' END")
    words = ", ".join(literal(w) for w in BOOLEAN_WORDS if not w.isdigit())
    digits = ", ".join(literal(w) for w in BOOLEAN_WORDS if w.isdigit())
    return (f"CASE WHEN {v} IN ({digits}) THEN 'bit' WHEN lower({v}) IN ({words}) THEN 'word' "
            f"WHEN {_like(v, NUMBER)} THEN if(contains({v}, '.'), 'real', 'whole') "
            f"WHEN {_like(v, RECENT_MONTH)} AND try_cast({v} AS timestamp) IS NOT NULL THEN 'date' "
            "ELSE 'text' END")


def _verdict(mode: str) -> str:
    """SQL text of the type, from the number of cells per class."""
    def only(*kinds: str) -> str:
        return f"sum(if(kind IN ({', '.join(literal(k) for k in kinds)}), n, 0)) = sum(n)"

    def share(*kinds: str) -> str:
        return (f"sum(if(kind IN ({', '.join(literal(k) for k in kinds)}), n, 0)) / sum(n) "
                f"> {DATE_SHARE}")

    if mode == "sample5":
        return (f"CASE WHEN {only('bit', 'word')} THEN 'BOOLEAN' WHEN {only('date')} THEN "
                f"'DATETIME' WHEN {only('bit', 'whole')} THEN 'INTEGER' "
                f"WHEN {only('bit', 'whole', 'real')} THEN 'REAL' ELSE 'VARCHAR(255)' END")
    return (f"CASE WHEN {only('whole')} THEN 'INTEGER' WHEN {only('whole', 'real')} THEN 'REAL' "
            f"WHEN {share('date', 'moment')} OR {share('slash')} THEN 'DATETIME' ELSE 'TEXT' END")


@any_table("string")
def infer_types(df: DataFrame, mode: str = "strict") -> DataFrame:
    """(column, ordinal, inferred_type) for the text columns of `df`.

    strict: numbers, else dates in more than 80 % of the values, else TEXT.
    sample5: booleans and recent dates come before numbers; VARCHAR(255) is the rest.
    regex100: plain digits only, signs and exponents in numbers are text.

    One scan classes every cell and adds into a handful of counters per column.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    order = {f.name: i for i, f in enumerate(df.schema.fields, start=1)}
    fields = text_fields(df)
    if not fields:
        raise NoColumns("no text column")
    counts = (melt(df, {f.name: _value(f.name) for f in fields}).where("value IS NOT NULL")
              .selectExpr("column", f"{_kind(mode)} AS kind")
              .groupBy("column", "kind").agg(F.count(F.lit(1)).alias("n")))
    found = counts.groupBy("column").agg(F.expr(_verdict(mode)).alias("inferred_type"))
    known = small_relation(df.sparkSession, [(f.name, order[f.name]) for f in fields],
                           "column string, ordinal int")
    empty = "VARCHAR(255)" if mode == "sample5" else "TEXT"
    return known.join(found, "column", "left").select(
        "column", "ordinal", F.coalesce("inferred_type", F.lit(empty)).alias("inferred_type"))


def type_map(inferred: DataFrame) -> dict[str, str]:
    """The inferred types by column (schema-sized)."""
    return {r["column"]: r["inferred_type"] for r in inferred.collect()}


def typed_value(name: str, kind: str) -> str:
    """SQL text reading a text cell as the given type; NULL when it does not fit."""
    v = _value(name)
    if kind == "INTEGER":
        return f"try_cast({_number(v)} AS bigint)"
    if kind == "REAL":
        return _number(v)
    if kind == "DATETIME":
        formats = ", ".join(f"cast(try_to_timestamp({v}, {literal(f)}) AS timestamp_ntz)"
                            for f in MOMENT_FORMATS)
        return f"coalesce(try_cast({v} AS timestamp_ntz), {formats})"
    return f"try_cast({v} AS {SQL_TYPES[kind]})"


def apply_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Read text columns as the types found; values that do not fit become NULL."""
    return measure(df, {c: typed_value(c, types[c]) if c in types else quoted(c)
                        for c in df.columns})


def cast_failures(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """(column, inferred_type, failures): values lost by `apply_types`, in one scan."""
    parts = []
    for chunk in chunks(list(types.items()), COLUMNS_PER_AGGREGATE):
        wide = measure(df, {
            f"c{i}": f"count_if({_value(c)} IS NOT NULL AND {typed_value(c, t)} IS NULL)"
            for i, (c, t) in enumerate(chunk)})
        parts.append(long_rows(wide, [{
            "column": literal(c), "inferred_type": literal(t), "failures": f"c{i}"}
            for i, (c, t) in enumerate(chunk)]))
    return union_all(parts)
