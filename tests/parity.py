"""Side-by-side check of a registered job against its oracle SQL (DuckDB over the same Parquet).

Compares row count, column names and an order-insensitive fingerprint of the values, the way
the external correctness gate does. Usage::

    python -m tests.parity /root/testdata/sf0.01 [job ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def run_oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    try:
        return con.execute(sql).fetchdf()
    finally:
        con.close()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, dt.date):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, int):
        return repr(v)
    return str(v)


def fingerprint(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in row) for row in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple("" if x is None else x for x in r))


def compare(spark_pd: pd.DataFrame, oracle_pd: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pd.columns) != sorted(oracle_pd.columns):
        return False, f"columns differ: {sorted(spark_pd.columns)} vs {sorted(oracle_pd.columns)}"
    if len(spark_pd) != len(oracle_pd):
        return False, f"row count {len(spark_pd)} vs {len(oracle_pd)}"
    a, b = fingerprint(spark_pd), fingerprint(oracle_pd)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, first: spark={bad[0][0]} oracle={bad[0][1]}"
    return True, f"{len(a)} rows match"


def check(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    import __spark_entry__ as entry
    queries, oracle = entry.queries(), entry.oracle_sql()
    results = {}
    for name in names or list(oracle):
        t0 = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            t1 = time.time()
            want = run_oracle(oracle[name], sf_dir)
            ok, msg = compare(got, want)
        except Exception as exc:  # report and continue with the next job
            ok, msg, t1 = False, f"error: {type(exc).__name__}: {str(exc)[:400]}", time.time()
        results[name] = (ok, msg)
        if verbose:
            print(f"{'OK ' if ok else 'BAD'} {name:32s} {t1 - t0:6.2f}s  {msg}", flush=True)
    return results


if __name__ == "__main__":
    from ledgerline.session import build_session
    spark = build_session()
    res = check(spark, sys.argv[1], sys.argv[2:] or None)
    print(f"{sum(ok for ok, _ in res.values())}/{len(res)} match")
