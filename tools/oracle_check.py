"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import collections
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from siftwork.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402
from siftwork.session import local_session  # noqa: E402
from siftwork.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    load_all()
    if os.environ.get("ORACLE_PLAIN"):
        from pyspark.sql import SparkSession

        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    names = names or list(QUERIES)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, sf_dir)
            cols = sorted(df.columns)
            srows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} SPARK ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in ORACLES:
            print(f"{n:28s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.sql(ORACLES[n])
            dcols = rel.columns
            drows_raw = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} DUCKDB ERROR {str(e)[:600]}")
            bad += 1
            continue
        order = sorted(range(len(dcols)), key=lambda i: dcols[i])
        drows = [tuple(_norm(r[i]) for i in order) for r in drows_raw]
        same_cols = cols == sorted(dcols)
        cs, cd = collections.Counter(srows), collections.Counter(drows)
        ok = same_cols and cs == cd
        bad += not ok
        print(f"{n:28s} {'OK ' if ok else 'BAD'} spark={len(srows)} duck={len(drows)} {ts:.1f}s"
              + ("" if same_cols else f" cols {cols} vs {sorted(dcols)}"))
        if not ok and same_cols:
            only_s = list((cs - cd).elements())[:3]
            only_d = list((cd - cs).elements())[:3]
            print("   cols:", cols)
            for r in only_s:
                print("   spark only:", str(r)[:600])
            for r in only_d:
                print("   duck  only:", str(r)[:600])
    print("failures:", bad)


if __name__ == "__main__":
    main()
