"""Compare registered queries with their SQL on one data folder: python tools/compare.py [folder] [names...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple(None if v is None or v is pd.NA or v != v else (float(v) + 0.0 if isinstance(v, float) else v) for v in r))
    return sorted(rows, key=repr)


def compare(spark, con, folder: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    out = fn(spark, folder)
    got = pd.DataFrame([tuple(r) for r in out.collect()], columns=out.columns, dtype=object)
    took = time.time() - start
    if sql is None:
        return len(got) > 0, f"rows-only {len(got)} rows {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = pd.DataFrame(cur.fetchall(), columns=names, dtype=object)
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a == b:
        return True, f"{len(a)} rows {took:.1f}s"
    left, right = list(set(a) - set(b)), list(set(b) - set(a))
    return False, f"{len(a)} vs {len(b)} rows; {len(left)} differ, e.g. {sorted(left, key=repr)[:3]} != {sorted(right, key=repr)[:3]}"


if __name__ == "__main__":
    from panelweave.queries import ORACLE, QUERIES
    from panelweave.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    session = local_session("compare", 8, 8)
    session.sparkContext.setLogLevel("ERROR")
    con = oracle(folder)
    bad = 0
    for n in names:
        try:
            ok, text = compare(session, con, folder, n, QUERIES[n], ORACLE.get(n))
        except Exception as e:  # a broken query must not hide the others
            ok, text = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", n, text, flush=True)
    print("failed:", bad)
    session.stop()
    sys.exit(bool(bad))
