"""Compares a query with its oracle SQL the way the driver does: columns by name, rows as a set of values."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(d: str = DATA):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(d)):
        if f.endswith(".parquet"):
            p = f"{d}/{f}" if os.path.isfile(f"{d}/{f}") else f"{d}/{f}/*.parquet"
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def rows_of_sql(c, q):
    cur = c.execute(q)
    names = [x[0] for x in cur.description]
    cols = sorted(names)
    at = [names.index(x) for x in cols]
    return cols, Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
