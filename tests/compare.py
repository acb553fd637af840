"""Spark's rows against DuckDB's, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def differences(df, c, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    result = c.execute(sql)
    names = [x[0] for x in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, expected {sorted(names)}"
    got, expected = rows_of(df.columns, df.collect()), rows_of(names, result.fetchall())
    if got == expected:
        return ""
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    i = next(i for i, (a, b) in enumerate(zip(got, expected)) if a != b)
    return f"row {i}: {got[i]}, expected {expected[i]}"
