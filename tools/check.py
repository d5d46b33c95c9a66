"""Run registered queries against their SQL in DuckDB and compare row by row.

usage: python tools/check.py [--sf DIR] [--like TEXT] [--explain]
"""

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wirelens.catalog import ORACLES, QUERIES  # noqa: E402
from wirelens.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return f"{type(v).__name__}:{v}"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name, sf_dir):
    began = time.time()
    df = QUERIES[name](spark, sf_dir)
    got, names = canonical(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - began
    if name not in ORACLES:
        return "rows", len(got), spent, 0.0, ""
    began = time.time()
    cur = con.execute(ORACLES[name])
    want, want_names = canonical([d[0] for d in cur.description], cur.fetchall())
    sql_spent = time.time() - began
    if names != want_names:
        return "NAMES", len(got), spent, sql_spent, f"{names} != {want_names}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return "DIFF", len(got), spent, sql_spent, (
            f"rows {len(got)} vs {len(want)}; spark only {len(a)}: {sorted(a)[:2]}; sql only {len(b)}: {sorted(b)[:2]}")
    return "ok", len(got), spent, sql_spent, ""


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--like", default="")
    ap.add_argument("--only", nargs="*")
    ap.add_argument("--explain", action="store_true")
    args = ap.parse_args()
    spark = build_session(master="local[8]", shuffle_partitions=8,
                          **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in QUERIES:
        if (args.only and name not in args.only) or args.like not in name:
            continue
        if args.explain:
            print("=====", name)
            QUERIES[name](spark, args.sf).explain("formatted")
            continue
        try:
            status, n, spent, sql_spent, note = compare(spark, con, name, args.sf)
        except Exception as e:  # report and go on with the next query
            status, n, spent, sql_spent, note = "ERROR", 0, 0.0, 0.0, f"{type(e).__name__}: {str(e)[:600]}"
        bad += status not in ("ok", "rows")
        print(f"{status:6} {name:28} rows={n:<7} spark={spent:6.2f}s sql={sql_spent:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
