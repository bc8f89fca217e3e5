"""Run registered queries in Spark and their oracle SQL in DuckDB; compare rows, columns and values.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from graphsig.plans.catalog import ORACLE, QUERIES  # noqa: E402
from graphsig.session import build_session  # noqa: E402
from graphsig.sources.tables import TABLES  # noqa: E402


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return canon(v.tolist())
    return str(v)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    vals = sorted(tuple(canon(r[i]) for i in order) for r in rows)
    return cols, vals


def duck(sf_dir):
    con = duckdb.connect(config={"memory_limit": "6GB", "threads": 4})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        if name not in ORACLE:
            print(f"{name:34s} rows={len(rows):8d} spark={t1 - t0:6.1f}s  (no oracle)")
            continue
        rel = con.sql(ORACLE[name])
        drows = rel.fetchall()
        t2 = time.time()
        sc, sv = normalise(df.columns, rows)
        dc, dv = normalise(rel.columns, drows)
        ok = sc == dc and sv == dv
        bad += not ok
        msg = "OK " if ok else "BAD"
        print(f"{name:34s} {msg} rows={len(rows):8d}/{len(drows):8d} spark={t1 - t0:6.1f}s duck={t2 - t1:6.1f}s")
        if not ok:
            if sc != dc:
                print("   columns", sc, dc)
            else:
                diff = [x for x in sv if x not in set(dv)][:3]
                print("   spark-only", diff)
                print("   duck-only ", [x for x in dv if x not in set(sv)][:3])
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
