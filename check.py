"""Compare registered queries with their oracle SQL: ``python check.py [sf] [name ...]``."""

from __future__ import annotations

import signal
import sys
import time

import duckdb
import pandas as pd

from framestride.plans.catalog import ORACLES, QUERIES
from framestride.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA else (str(v) if not isinstance(v, (int, float, bool)) else v))
        elif str(df[c].dtype) in ("Int64", "Int32", "boolean", "Float64"):
            df[c] = df[c].astype("float64")
        elif df[c].dtype.kind in "iub":
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    failed = []
    for name in names:
        start = time.time()
        signal.signal(signal.SIGALRM, lambda *_: (_ for _ in ()).throw(TimeoutError("60 s")))
        signal.alarm(60)
        try:
            got = QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            want = con.execute(ORACLES[name]).df()
            a, b = normal(got), normal(want)
            if list(a.columns) != list(b.columns):
                raise AssertionError(f"columns {list(a.columns)} != {list(b.columns)}")
            if len(a) != len(b):
                raise AssertionError(f"rows {len(a)} != {len(b)}")
            differ = [c for c in a.columns if not ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all()]
            if differ:
                c = differ[0]
                bad = a[~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))].index[:3]
                raise AssertionError(f"values differ in {differ}\n{a.loc[bad]}\n{b.loc[bad]}")
            types = {c: (got[c].dtype, want[c].dtype) for c in got.columns if got[c].dtype.kind != want[c].dtype.kind}
            print(f"ok    {name}: {len(a)} rows, {took:.1f}s {types or ''}", flush=True)
        except Exception as e:  # report and go on
            failed.append(name)
            spark.sparkContext.cancelAllJobs()
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
        finally:
            signal.alarm(0)
    print(f"{len(names) - len(failed)}/{len(names)} passed; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
