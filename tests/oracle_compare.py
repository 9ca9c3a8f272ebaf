"""Run registered queries in Spark and their DuckDB twins; compare results.

    python tests/oracle_compare.py [sf_dir] [name ...]

Mirrors the driver's check: same column names, same row count, same
multiset of rows (floats compared exactly, then with a relative tolerance
as a diagnostic).
"""

from __future__ import annotations

import math

import pandas as pd
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(float(v)))
    if hasattr(v, "item"):
        v = v.item()
        return _norm(v)
    return (1, repr(v))


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out)


def _close(a, b):
    if a == b:
        return True
    try:
        x, y = float(a[1]), float(b[1])
        return abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y))
    except Exception:
        return False


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sp = fn(spark, sf_dir).toPandas()
    ts = time.time() - t
    if sql is None:
        return dict(name=name, rows=len(sp), oracle=None, spark_s=round(ts, 2))
    dd = con.execute(sql).df()
    c1, r1 = _rows(sp)
    c2, r2 = _rows(dd)
    res = dict(name=name, rows=len(sp), oracle_rows=len(dd), cols_ok=c1 == c2, spark_s=round(ts, 2))
    if c1 != c2:
        res["cols"] = (c1, c2)
        res["ok"] = False
        return res
    kinds = {c: (str(sp[c].dtype), str(dd[c].dtype)) for c in c1
             if (sp[c].dtype.kind in "iuf") != (dd[c].dtype.kind in "iuf")
             or (sp[c].dtype.kind in "iu") != (dd[c].dtype.kind in "iu")
             or str(dd[c].dtype) in ("Int64", "Int32")}
    if kinds:
        res["dtype_diff"] = kinds
    res["exact"] = r1 == r2
    if not res["exact"] and len(r1) == len(r2):
        bad = [(a, b) for a, b in zip(r1, r2) if not all(_close(x, y) for x, y in zip(a, b))]
        res["close"] = not bad
        if bad:
            res["first_bad"] = bad[0]
    res["ok"] = res["exact"]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from leadspark.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for n, fn in qs.items():
        if names and n not in names:
            continue
        try:
            r = compare(spark, con, n, fn, ors.get(n), sf_dir)
        except Exception as e:  # report and continue
            r = dict(name=n, error=repr(e)[:800])
        if r.get("ok") is False or "error" in r:
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
