"""Compare registered queries with their SQL on the given tables (run as a script too)."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from noticemill.plans.views import TABLES


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return True, f"{name}: rows-only {len(got)} rows {took:.1f}s"
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = _rows(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        only_g = [r for r in got if r not in set(want)][:2]
        only_w = [r for r in want if r not in set(got)][:2]
        return False, f"{name}: {len(got)} vs {len(want)} rows; spark {only_g} sql {only_w} cols {sorted(columns)}"
    return True, f"{name}: ok {len(got)} rows {took:.1f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry_module
    from noticemill.session import build_session

    sf = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.001")
    wanted = sys.argv[2:]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = duck(sf), entry_module.oracle_sql()
    bad = 0
    for key, fn in entry_module.queries().items():
        if wanted and not any(w in key for w in wanted):
            continue
        try:
            ok, text = compare(spark, sf, key, fn, oracle.get(key), con)
        except Exception as exc:  # noqa: BLE001
            ok, text = False, f"{key}: {type(exc).__name__} {str(exc)[:600]}"
        bad += not ok
        print(("" if ok else "FAIL ") + text[:1500], flush=True)
    print("failures:", bad)
