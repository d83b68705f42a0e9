"""Compare registered queries with their SQL on DuckDB. Run as a script for a report."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (bool, str)):
        return v
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    return cols, sorted(out, key=repr)


def rows_of_duck(folder, sql):
    con = duckdb.connect()
    con.execute("set memory_limit='8GB'; set max_temp_directory_size='6GB'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    rel = con.sql(sql)
    names = list(rel.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(df, folder, sql):
    """None when equal, else a short text on the difference."""
    cols, got = rows_of_spark(df)
    want_cols, want = rows_of_duck(folder, sql)
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        a, b = set(got), set(want)
        return f"rows {len(got)} != {len(want)}; only spark {list(a - b)[:2]}; only sql {list(b - a)[:2]}"
    for g, w in zip(got, want):
        if g != w:
            a, b = set(got), set(want)
            return f"{len(a - b)} differ; only spark {list(a - b)[:2]}; only sql {list(b - a)[:2]}"
    return None


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from showgrid.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", 8, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [q for q in queries if not argv or any(a == q or (a.endswith("*") and q.startswith(a[:-1])) for a in argv)]
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                verdict = compare(df, folder, oracles[name])
                n = ""
            else:
                verdict, n = None, f"rows={df.count()}"
        except Exception as e:  # report and go on with the next query
            verdict, n = f"{type(e).__name__}: {str(e)[:900]}", ""
        took = time.time() - start
        if verdict:
            bad += 1
        print(f"{'FAIL' if verdict else 'ok  '} {name} {took:.1f}s {n} {verdict or ''}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
