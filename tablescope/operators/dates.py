"""Dates held as text: which columns hold them, and in which notation.

Two steps: one scan per table tells how many cells each notation reads, and its
outcome (schema-sized) selects the one parser that later scans apply to a column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import (cast, chunks, literal, long_rows, measure, quoted, small_relation,
                               temporal_fields, text_fields, union_all)

Tables = Mapping[str, DataFrame]
#: column -> notation
Notations = Mapping[str, str]

# --- fixed values: how text starts that holds a date, and names that promise one -----
DATE_START = r"^\d{4}-\d{2}-\d{2}"
DATE_NAMES = ("date", "time")
# ---------------------------------------------------------------------------------------

#: The notation of dates that begin like DATE_START; the others are Spark patterns.
ISO = "ISO"
NOTATIONS = (ISO, "MM/dd/yyyy[ HH:mm[:ss]]", "dd/MM/yyyy[ HH:mm[:ss]]", "yyyy/MM/dd[ HH:mm[:ss]]",
             "dd.MM.yyyy[ HH:mm[:ss]]", "yyyyMMdd")
#: No notation writes a moment in more bytes, so longer cells are never parsed.
MOMENT_BYTES = 40


def text_moment(name: str, notation: str) -> str:
    """SQL text reading a text cell as a moment; NULL where it does not fit."""
    cell = f"trim({quoted(name)})"
    fits = f"octet_length({quoted(name)}) <= {MOMENT_BYTES} AND {cell} RLIKE "
    if notation == ISO:
        return f"if({fits}{literal(DATE_START)}, try_cast({cell} AS timestamp_ntz), NULL)"
    read = f"cast(try_to_timestamp({cell}, {literal(notation)}) AS timestamp_ntz)"
    return f"if({fits}'^[0-9]', {read}, NULL)"


def text_date_counts(tables: Tables, notations: Sequence[str] = NOTATIONS) -> DataFrame:
    """(table, column, ordinal, cells, dated, notation, place, readable) per text column and notation.

    `cells` counts cells that are not empty, `dated` those that start like a date. One
    scan per table and counters alone: no cell leaves its task.
    """
    parts = []
    for name, df in tables.items():
        order = {f.name: i for i, f in enumerate(df.schema.fields, start=1)}
        for chunk in chunks(text_fields(df), max(1, 100 // (len(notations) + 2))):
            aggs = {}
            for i, f in enumerate(chunk):
                aggs[f"n{i}"] = f"count(nullif(trim({quoted(f.name)}), ''))"
                aggs[f"s{i}"] = f"count_if({quoted(f.name)} RLIKE {literal(DATE_START)})"
                aggs |= {f"r{i}_{j}": f"count({text_moment(f.name, one)})"
                         for j, one in enumerate(notations)}
            parts.append(long_rows(measure(df, aggs), [{
                "table": literal(name), "column": literal(f.name), "ordinal": str(order[f.name]),
                "cells": f"n{i}", "dated": f"s{i}", "notation": literal(one), "place": str(j),
                "readable": f"r{i}_{j}"}
                for i, f in enumerate(chunk) for j, one in enumerate(notations)]))
    if not parts:
        return small_relation(next(iter(tables.values())).sparkSession, [],
                              "table string, column string, ordinal int, cells bigint, dated bigint, "
                              "notation string, place int, readable bigint")
    return union_all(parts)


def text_dates(tables: Tables, notations: Sequence[str] = NOTATIONS,
               names: Sequence[str] = DATE_NAMES) -> DataFrame:
    """(table, column, notation, cells, readable): text columns that hold dates.

    A column holds dates if its name promises them and some cell can be read, or if every
    cell starts like a date. The notation is the one that reads most cells; of equal ones
    the first in `notations`, so month before day where no cell tells them apart.
    """
    promised = " OR ".join(f"contains(lower(column), {literal(n)})" for n in names) or "false"
    best = Window.partitionBy("table", "column").orderBy(F.desc("readable"), "place")
    return (text_date_counts(tables, notations)
            .where(f"readable > 0 AND (({promised}) OR dated = cells)")
            .withColumn("nth", F.row_number().over(best)).where("nth = 1")
            .select("table", "column", "notation", "cells", "readable"))


def notations_of(found: DataFrame) -> dict[str, dict[str, str]]:
    """The notations by table and column, for the scans that follow (schema-sized)."""
    chosen: dict[str, dict[str, str]] = {}
    for r in found.select("table", "column", "notation").collect():
        chosen.setdefault(r["table"], {})[r["column"]] = r["notation"]
    return chosen


def date_moments(df: DataFrame, notations: Notations | None = None,
            columns: Sequence[str] | None = None) -> dict[str, str]:
    """SQL text of the moment of every date column: typed ones, then text of known notation."""
    exprs = {f.name: cast(quoted(f.name), "timestamp") for f in temporal_fields(df, columns)}
    return exprs | {f.name: text_moment(f.name, notations[f.name])
                    for f in text_fields(df, columns) if f.name in (notations or {})}
