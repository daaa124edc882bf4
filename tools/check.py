"""Runs queries next to their SQL twins in DuckDB and compares the rows.

usage: python tools/check.py [sf_dir] [name-part ...]"""

from __future__ import annotations

import datetime
import glob
import math
import os
import signal
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fleetlens import session  # noqa: E402
from fleetlens.plans import catalogue  # noqa: E402


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1 << 53 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = session.build("check", "local[8]", 8, {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    limit = int(os.environ.get("QUERY_SECONDS", "40"))

    def late(*_):
        raise TimeoutError(f"over {limit} s")

    signal.signal(signal.SIGALRM, late)
    bad = 0
    for name, fn in catalogue.QUERIES.items():
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        signal.alarm(limit)
        try:
            df = fn(spark, folder)
            cols = sorted(df.columns)
            got = [tuple(cell(r[c]) for c in cols) for r in df.collect()]
            took = time.time() - t
            if name not in catalogue.ORACLES:
                print(f"rows   {name} {len(got)} {took:.1f}s", flush=True)
                continue
            cur = db.execute(catalogue.ORACLES[name])
            have = [d[0] for d in cur.description]
            rows = cur.fetchall()
            if sorted(have) != cols:
                bad += 1
                print(f"COLS   {name} spark={cols} sql={sorted(have)}", flush=True)
                continue
            pick = [have.index(c) for c in cols]
            want = [tuple(cell(r[i]) for i in pick) for r in rows]
            key = lambda r: tuple(str(x) for x in r)
            a, b = sorted(got, key=key), sorted(want, key=key)
            if a == b:
                print(f"ok     {name} {len(a)} {took:.1f}s" + ("  EMPTY" if not a else ""), flush=True)
            else:
                bad += 1
                sa, sb = set(a), set(b)
                only_a = [r for r in a if r not in sb][:2]
                only_b = [r for r in b if r not in sa][:2]
                print(f"DIFF   {name} spark={len(a)} sql={len(b)} {cols}\n   spark {str(only_a)[:600]}\n   sql   {str(only_b)[:600]}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            signal.alarm(0)
            spark.sparkContext.cancelAllJobs()
            print(f"ERROR  {name} {str(e)[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
