"""Runs registered queries on Spark and their SQL on DuckDB and compares the results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
import __spark_entry__ as entry  # noqa: E402

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
conversations""".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str):
    """None when equal, else a description of the first differences."""
    start = time.time()
    df = entry.queries()[name](spark, folder)
    got = _canonical(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    cur = con.execute(entry.oracle_sql()[name])
    want = _canonical([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return took, len(got[1]), f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        return took, len(got[1]), f"rows {len(got[1])}/{len(want[1])}\n  spark {extra}\n  duckdb {missing}"
    return took, len(got[1]), None


if __name__ == "__main__":
    from curvelens.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.oracle_sql())
    spark, con = local_session(8), duck(folder)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        try:
            took, n, diff = compare(spark, con, name, folder)
        except Exception as e:  # report and go on with the next query
            took, n, diff = 0, 0, f"{type(e).__name__}: {str(e)[:300]}"
        bad += diff is not None
        print(f"{name:34s} {n:7d} rows {took:6.2f}s {'ok' if diff is None else 'DIFF ' + diff}", flush=True)
    print("differences:", bad)
