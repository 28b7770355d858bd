"""Run registered queries next to their SQL in DuckDB: `python tools/check.py [sf_dir] [name ...]`."""

from __future__ import annotations

import importlib.util
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from dealgrid.plans.views import BASE_TABLES  # noqa: E402
from dealgrid.session import local_session  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(0.0 if v == 0 else float(f"{v:.12g}"))
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    spark_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    duck_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if spark_cols != duck_cols:
        return f"columns {spark_cols} != {duck_cols}", len(got)
    if got != want:
        a, b = set(got), set(want)
        only_s, only_d = sorted(a - b)[:3], sorted(b - a)[:3]
        return f"rows {len(got)} vs {len(want)}\n  cols  {spark_cols}\n  spark {str(only_s)[:500]}\n  duck  {str(only_d)[:500]}", len(got)
    return "", len(got)


def main(argv):
    sf_dir = next((a for a in argv if "/" in a), "/root/testdata/sf0.01")
    names = [a for a in argv if "/" not in a]
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    spark = local_session(8)
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) or fn.__module__.endswith(n) or getattr(fn, "area", "") == n for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                msg, n = compare(df, con, oracles[name])
            else:
                msg, n = "", df.count()
        except Exception as exc:
            msg, n = "".join(traceback.format_exception_only(exc))[:900], -1
        state = "FAIL" if msg else ("ok" if name in oracles else "rows-only")
        bad += bool(msg)
        print(f"{state:9s} {name:28s} {n:8d} rows {time.time() - start:6.2f}s {msg}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
