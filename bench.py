"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores) choose
the data and the parallelism. Each query runs once to warm the JVM, then counts its
best of two.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import queries  # noqa: E402
from tablescope.session import build_session  # noqa: E402

HEADLINE = ("null_profile_all", "column_profile", "numeric_stats_lineitem", "histogram_lineitem",
            "correlation_lineitem", "iqr_outliers_lineitem", "top_values_orders",
            "text_stats_documents", "date_stats_lineitem", "fk_integrity", "fk_cardinality",
            "key_violations", "candidate_keys", "discover_fks", "infer_types_strict",
            "date_sequence", "scorecard6", "issues_module")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        best = None
        for attempt in range(3):
            start = time.perf_counter()
            queries.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt:
                best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    found = re.search(r"sf([\d.]+)/?$", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": float(found.group(1)) if found else sf_dir,
                      "cpus": int(cpus), "shuffle_partitions": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
