"""Run catalogue queries against their SQL twins: ``python tests/compare.py [sf_dir] [name ...]``."""

import datetime
import decimal
import glob
import math
import os
import sys
import threading
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(float(v)) else f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


LIMIT = 40


def guarded(stop, work):
    """Run ``work``; call ``stop`` when it takes too long."""
    timer = threading.Timer(LIMIT, stop)
    timer.start()
    try:
        return work()
    finally:
        timer.cancel()


def compare(spark, con, sf, name, fn, sql):
    start = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in guarded(spark.sparkContext.cancelAllJobs, df.collect)]
    took = time.time() - start
    if sql is None:
        return "ROWS", len(got), took, ""
    start = time.time()
    cur = guarded(con.interrupt, lambda: con.execute(sql))
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    oracle = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return "OK", len(got), took, f"oracle {oracle:.1f}s"
    in_a, in_b = set(a), set(b)
    left, right = [r for r in a if r not in in_b][:3], [r for r in b if r not in in_a][:3]
    return "DIFF", len(got), took, f"{len(a)} vs {len(b)}\n   spark {left}\n   oracle {right}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    import __spark_entry__ as entry
    from rapport.session import build_session

    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    print(flush=True)
    for name, fn in entry.queries().items():
        print("->", name, file=sys.stderr, flush=True)
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            verdict, n, took, note = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            verdict, n, took, note = "ERROR", 0, 0.0, str(e)[:900]
        bad += verdict not in ("OK", "ROWS")
        print(f"{verdict:8}{name:36}{n:8}{took:7.1f}s  {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
