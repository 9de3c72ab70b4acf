"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm_value(v):
    import datetime as dt

    import numpy as np
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float | np.floating):
        if math.isnan(v):
            return None
        return round(float(v), 5)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm_value(x) for x in v)
    if v is pd.NaT:
        return None
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm_value(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return name, "NO-SQL", len(spdf), None, t1 - t0
    dpdf = con.execute(sql).df()
    scols, srows = rows_of(spdf)
    dcols, drows = rows_of(dpdf)
    ok = scols == dcols and srows == drows
    detail = ""
    if scols != dcols:
        detail = f"cols spark={scols} duck={dcols}"
    elif len(srows) != len(drows):
        detail = f"rows spark={len(srows)} duck={len(drows)}"
    elif not ok:
        diff = [(a, b) for a, b in zip(srows, drows) if a != b][:3]
        detail = f"first diffs: {diff}"
    return name, "OK" if ok else "MISMATCH", len(srows), detail, t1 - t0


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    import __spark_entry__ as ent
    from chronotok.session import local_session

    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = ent.queries(), ent.oracle_sql()
    names = args or list(qs)
    bad = 0
    for n in names:
        try:
            res = compare(spark, con, n, qs[n], sqls.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001
            res = (n, "ERROR", 0, repr(e)[:600], 0)
        print(f"{res[0]:28s} {res[1]:9s} rows={res[2]:<8} {res[4]:.1f}s {res[3] or ''}", flush=True)
        bad += res[1] not in ("OK", "NO-SQL")
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
