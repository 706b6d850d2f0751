"""Run every query that has an SQL twin on both engines and compare all values: python tests/oracle_check.py [dir] [prefix]."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else float(f"{v:.12g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def differ(df, con, sql: str) -> str:
    """What differs between a frame and a statement's rows, columns sorted by name; "" for nothing."""
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    order = sorted(names)
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got), key=key)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=key)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows, first {bad[0]}" if bad else ""


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefix = sys.argv[2] if len(sys.argv) > 2 else ""
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, failed = connect(sf_dir), entry.queries(), 0
    for name, sql in entry.oracle_sql().items():
        if not name.startswith(prefix):
            continue
        began = time.time()
        try:
            wrong = differ(queries[name](spark, sf_dir), con, sql)
        except Exception as e:  # noqa: BLE001
            wrong = f"{type(e).__name__}: {str(e)[:400]}"
        failed += bool(wrong)
        if wrong:
            print(f"{name}: {wrong}")
        elif time.time() - began > 3:
            print(f"{name}: ok, {time.time() - began:.1f} s")
    print(f"{failed} of {len(entry.oracle_sql())} differ")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
