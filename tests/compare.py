"""Holds a query's rows against its SQL on the same files."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, run, sql: str, folder: str) -> list[str]:
    df = run(spark, folder)
    found = df.collect()
    wanted = connection(folder).sql(sql)
    if sorted(df.columns) != sorted(wanted.columns):
        return [f"columns {sorted(df.columns)} and {sorted(wanted.columns)}"]
    a, b = rows_of(df.columns, found), rows_of(wanted.columns, wanted.fetchall())
    out = [f"{len(found)} rows and {sum(b.values())}"] if len(found) != sum(b.values()) else []
    return out + [f"only Spark: {x}" for x in list(a - b)[:3]] + [f"only SQL: {x}" for x in list(b - a)[:3]]
