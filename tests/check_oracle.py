"""Run every query and its SQL side by side: ``python tests/check_oracle.py [folder] [name part ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_points  # noqa: E402
from cellquery.session import local_session  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, folder: str, name: str) -> str:
    """Empty if the query gives the same columns and rows as its SQL."""
    df = entry_points.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    frame = con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description
    expected_columns = sorted(d[0] for d in frame)
    if expected_columns != columns:
        return f"columns {columns} != {expected_columns}"
    listed = ", ".join(f'"{c}"' for c in columns)
    expected = con.execute(f"SELECT {listed} FROM ({sql})").fetchall()
    key = lambda r: tuple((v is None, repr(v)) for v in r)
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}; first {next((p for p in zip(got, expected) if p[0] != p[1]), None)}"
    wrong = [p for p in zip(got, expected) if p[0] != p[1] or [type(v) for v in p[0]] != [type(v) for v in p[1]]]
    return f"{len(wrong)} of {len(got)} rows differ; first {wrong[0]}" if wrong else ""


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    parts = sys.argv[2:]
    spark = local_session("8", "8g", "oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in entry_points.queries():
        if parts and not any(p in name for p in parts):
            continue
        began = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.1f}s {problem[:1500]}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
