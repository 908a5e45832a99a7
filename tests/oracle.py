"""Compare a registered query with its SQL on DuckDB (also a command-line tool)."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if value != value else f"{value + 0.0:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if bad in plan:
            return False, f"plan holds {bad}"
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"{len(got)} rows, {t1 - t0:.1f}s (no SQL)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = rows_of(names, cur.fetchall())
    took = f"{t1 - t0:.1f}s / {time.time() - t1:.1f}s"
    if got_cols != want_cols:
        return False, f"columns {got_cols} <> {want_cols}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return False, f"{len(got)} vs {len(want)} rows, {took}; spark/sql {diff}"
    return True, f"{len(got)} rows, {took}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from nestfold.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    wanted = sys.argv[1:]
    bad = 0
    for name, fn in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, text = compare(spark, con, sf, name, fn, e.oracle_sql().get(name))
        except Exception as err:  # report and go on
            ok, text = False, f"{type(err).__name__}: {str(err)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, text, flush=True)
    print("failures:", bad)
