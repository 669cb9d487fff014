"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the cores. Every query is run to its
last row, with all columns, into the no-op sink: one warm-up, then the median of three runs.
The given tables are one file of one row group each, which a single task has to read; they are first
written out as ``FILES`` files each, as tables of any size are. That is not timed.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellquery import catalog  # noqa: E402
from cellquery.session import local_session  # noqa: E402

HEADLINE = [
    "h6_paragraph",
    "h9_extract_cells",
    "h12_page_sentences",
    "m1_strict_sentences",
    "m3_words",
    "m4_cell_index",
    "m6_word_hits",
    "m8_build_qa",
    "harvest_pages",
    "q11_rework_qa",
    "p1_table_to_csv",
    "s7_qa_with_tables",
    "e4_e5_evaluate_rows",
    "e6_accuracy",
    "e7_run_plan",
    "e11_table_index",
]
FILES = 32
INPUT_ROWS = {"h6_paragraph": "pages", "m6_word_hits": "documents", "h9_extract_cells": "customer", "e6_accuracy": "lineitem"}


def timed(run) -> float:
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def in_files(spark, folder: str) -> str:
    """A copy of the tables in several files each."""
    copy = tempfile.mkdtemp(prefix="cellquery-bench-")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        spark.read.parquet(path).repartition(FILES).write.parquet(f"{copy}/{os.path.basename(path)}")
    return copy


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "8g"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    copy = in_files(spark, folder)
    queries = catalog.queries()
    seconds = {}
    for name in names:
        run = lambda: queries[name](spark, copy)  # noqa: B023, E731
        timed(run)
        seconds[name] = round(statistics.median(timed(run) for _ in range(3)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    per_second = {}
    for name, source in INPUT_ROWS.items():
        if name in seconds:
            rows = spark.read.parquet(f"{copy}/{source}.parquet").count()
            per_second[f"{source}/s {name}"] = round(rows / seconds[name])
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": per_second,
                "cpus": int(cpus),
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
