"""Helpers of these tests."""

import hashlib

import duckdb

TABLES = "documents labels conversations benchmark pages"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def matches_sql(spark, name, folder="/root/testdata/sf0.001"):
    from tenderloom.llm.queries import CHECKS, JOBS
    from tests.checker import compare, connect

    problem = compare(JOBS[name](spark, folder), connect(folder), CHECKS[name])
    assert problem is None, problem


def on_tables(spark, tmp_path, name, **tables):
    """The query's rows over small tables, and its SQL's rows over the same."""
    from tenderloom.llm.queries import CHECKS, JOBS
    from tests.checker import rows_of

    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    made = JOBS[name](spark, str(tmp_path))
    got = rows_of(made.columns, [tuple(r) for r in made.collect()])
    if name not in CHECKS:
        return got, None
    cur = con.execute(CHECKS[name])
    return got, rows_of([c[0] for c in cur.description], cur.fetchall())
