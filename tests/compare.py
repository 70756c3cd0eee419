"""Runs registered queries beside their SQL in DuckDB and compares whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{v:d}" if abs(v) > 999999 else f"{float(v):.6g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return repr(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, con, folder, job, sql) -> str | None:
    """NULL when both results are equal, else a short description."""
    df = job(spark, folder)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return f"rows {len(got[1])} vs {len(want[1])}; spark only {sorted(a)[:2]}; sql only {sorted(b)[:2]}"
    return None if got[1] else "both empty"


def main(argv):
    sys.path.insert(0, ".")
    from rollweave.plans import full_catalog
    from rollweave.session import local_session

    folder = argv[0]
    catalog = full_catalog()
    names = argv[1:] or list(catalog.jobs)
    spark, con = local_session("8", 8), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in catalog.sql:
                problem = difference(spark, con, folder, catalog.jobs[name], catalog.sql[name])
            else:
                df = catalog.jobs[name](spark, folder)
                problem = None if df.count() else "empty"
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
