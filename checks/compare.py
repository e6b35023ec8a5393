"""Run every registered query beside its oracle and compare schema, rows and values.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback

import duckdb
from pyspark.sql import DataFrame, SparkSession

from .data import SCHEMA


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SCHEMA:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return repr(value)


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(_cell(r[i])) for i in order) for r in rows))


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, oracle: str) -> str | None:
    """None when both sides agree, else a short description."""
    result = con.sql(oracle)
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} / {sorted(result.columns)}"
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = _rows(result.columns, result.fetchall())
    if ours == theirs:
        return None
    missing = [r for r in theirs if r not in set(ours)][:3]
    surplus = [r for r in ours if r not in set(theirs)][:3]
    return (f"rows {len(ours)} / {len(theirs)}\n   columns {sorted(df.columns)}\n"
            f"   only in oracle {missing}\n   only here {surplus}")


def main() -> int:
    from . import queries
    from tablescope.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries.REGISTRY)
    spark: SparkSession = build_session("checks", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            query = queries.REGISTRY[name]
            df = queries.run(name, spark, sf_dir)
            if query.oracle is None:
                outcome = f"rows only: {df.count()}"
            else:
                diff = difference(df, con, query.oracle)
                failed += diff is not None
                outcome = "ok" if diff is None else f"DIFFERENT {diff}"
        except Exception as error:  # report and go on with the next query
            failed += 1
            outcome = f"ERROR {type(error).__name__} {str(error)[:600]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        print(f"{name:32s} {time.time() - start:6.2f}s {outcome}", flush=True)
    print(f"{len(names) - failed} of {len(names)} fine")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
