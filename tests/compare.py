"""Run registered queries and their DuckDB text on the same folder and compare whole results.

``python tests/compare.py [folder] [name-prefix ...]``
"""

from __future__ import annotations

import collections
import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tablewarden.plans.views import BASE_TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, collections.Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), collections.Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def difference(df, con, sql) -> str | None:
    """None when equal, else a short text."""
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    if sc != dc:
        return f"columns {sc} != {dc}"
    if sr != dr:
        return f"rows {sum(sr.values())} vs {sum(dr.values())}; only spark {list((sr - dr).items())[:3]}; only duckdb {list((dr - sr).items())[:3]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tablewarden.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = build_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                rows = ""
            else:
                problem, rows = None, f"rows only: {df.count()}"
        except Exception as e:  # report and go on
            problem, rows = f"{type(e).__name__}: {str(e)[:1500]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {rows} {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
