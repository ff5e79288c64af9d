"""Runs registered queries against their SQL on the test tables and reports differences.

    python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from gaugeframe.session import build_session  # noqa: E402

DATA = "/root/testdata/sf{sf}"


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows), [names[i] for i in order]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    """(status, detail, seconds of the Spark query)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got, names = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return "rows", f"{len(got)} rows", took
    result = con.execute(sql)
    want, want_names = rows_of([c[0] for c in result.description], result.fetchall())
    if names != want_names:
        return "FAIL", f"columns {names} vs {want_names}", took
    if len(got) != len(want):
        return "FAIL", f"{len(got)} rows vs {len(want)}", took
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return "FAIL", f"{len(wrong)} of {len(got)} differ\n   {names}\n   got  {wrong[0][0]}\n   want {wrong[0][1]}", took
    return "ok", f"{len(got)} rows", took


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry

    sf_dir = DATA.format(sf=args.sf)
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args.names or queries:
        try:
            status, detail, took = compare(spark, con, sf_dir, queries[name], oracle.get(name))
        except Exception as error:  # noqa: BLE001
            status, detail, took = "FAIL", str(error)[:1500], 0.0
        failed += status == "FAIL"
        print(f"{status:5} {name:28} {took:6.2f}s  {detail}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
