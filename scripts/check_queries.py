"""Run registered queries against DuckDB on the same tables and report differences.

    python scripts/check_queries.py [--sf /root/testdata/sf0.01] [names or substrings ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from importlib import import_module

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from closeline import session  # noqa: E402
from closeline.plans import registry, views  # noqa: E402
import closeline.plans as plans  # noqa: E402


def key(row):
    return tuple("\0" if v is None else (repr(v) if isinstance(v, float) else str(v)) for v in row)


def family(t) -> str:
    t = str(t).lower()
    for names, label in ((("bigint", "long"), "i64"), (("hugeint",), "huge"), (("int",), "i32"), (("double",), "f64"), (("decimal",), "dec"),
                         (("varchar", "string"), "str"), (("bool",), "bool"), (("timestamp",), "ts"), (("date",), "date")):
        if any(t.startswith(n) for n in names):
            return label
    return t


def compare(spark, con, name, folder):
    began = time.time()
    frame = registry.QUERIES[name](spark, folder)
    cols = sorted(frame.columns)
    left = [tuple(r) for r in frame.select(*cols).collect()]
    took = time.time() - began
    if name not in registry.ORACLES:
        return f"rows-only {len(left)}", took
    res = con.sql(registry.ORACLES[name])
    if sorted(res.columns) != cols:
        return f"COLUMNS {cols} vs {sorted(res.columns)}", took
    st = {f.name: family(f.dataType.simpleString()) for f in frame.schema}
    dt = {c: family(t) for c, t in zip(res.columns, res.types)}
    bad = {c: (st[c], dt[c]) for c in cols if st[c] != dt[c]}
    right = [tuple(r[res.columns.index(c)] for c in cols) for r in res.fetchall()]
    if bad:
        return f"TYPES {bad}", took
    if len(left) != len(right):
        return f"ROWS {len(left)} vs {len(right)}", took
    left, right = sorted(left, key=key), sorted(right, key=key)
    only_l = sorted(set(map(key, left)) - set(map(key, right)))
    only_r = sorted(set(map(key, right)) - set(map(key, left)))
    if only_l or only_r or [key(r) for r in left] != [key(r) for r in right]:
        return f"DIFF {len(only_l)}/{len(only_r)} {cols}: {only_l[:2]} | {only_r[:2]}", took
    return f"ok {len(left)}" + (" EMPTY" if not left else ""), took


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module", action="append")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    for m in args.module or plans.MODULES:
        import_module(f"closeline.plans.{m}")
    spark = session.build("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in views.BASE:
        con.sql(f"create view {t} as select * from '{args.sf}/{t}.parquet'")
    bad = 0
    for name in registry.QUERIES:
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            out, took = compare(spark, con, name, args.sf)
        except Exception as e:  # noqa: BLE001
            out, took = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0.0
        ok = out.startswith(("ok", "rows-only")) and "EMPTY" not in out and out != "rows-only 0"
        bad += not ok
        print(f"{'  ' if ok else '!!'} {name:45s} {took:6.2f}s {out}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
