"""Run registered queries against their SQL; usable from pytest and by hand.

    python -m tests.checker --sf 0.01 [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_df, con, sql) -> str | None:
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first got {got[:2]} want {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {got_cols}\n  got  {bad[0][0]}\n  want {bad[0][1]}"
    return None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from tenderloom.session import local_session

    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("--no-oracle", action="store_true")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    folder = f"/root/testdata/sf{a.sf}"
    spark = local_session("8")
    con = connect(folder)
    jobs, checks = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in a.names or jobs:
        t = time.time()
        try:
            df = jobs[name](spark, folder)
            if name in checks and not a.no_oracle:
                problem = compare(df, con, checks[name])
                state = "ok" if problem is None else problem
            else:
                n = len(df.collect())
                state, problem = f"rows {n}", None
        except Exception as e:
            problem = state = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{name:34s} {time.time() - t:6.1f}s {state}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
