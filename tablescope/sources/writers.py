"""Writing catalogs, reports and dictionaries; every write is a distributed one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.catalog import Catalog

REPORT_FORMATS = ("parquet", "json", "csv", "orc")


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Write one report relation."""
    if fmt not in REPORT_FORMATS:
        raise ValueError(f"fmt must be one of {REPORT_FORMATS}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def write_catalog(cat: Catalog, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write the relations of a catalog below one folder."""
    for name in ("tables", "columns", "fks"):
        write_report(getattr(cat, name), f"{path}/{name}", fmt, mode)


def write_dictionary_csv(dictionary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Column dictionary as CSV with a header, all fields quoted, quotes doubled."""
    (dictionary.write.mode(mode).option("header", True).option("quoteAll", True)
     .option("escape", '"').csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table as CSV that `read_csv` reads back: doubled quotes, empty cells for NULL."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("emptyValue", '""').csv(path))
