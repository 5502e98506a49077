"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        x = float(v)
        return "NaN" if math.isnan(x) else str(v) if isinstance(v, int) and abs(v) > 10**9 else f"{x:.6g}"
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def connection(root: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(root).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def difference(con, df, sql: str) -> str:
    """Nothing when both have the same columns and rows; else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(row[names.index(c)]) for c in order) for row in result.fetchall())
    got = Counter(tuple(plain(row[c]) for c in order) for row in df.collect())
    return "" if got == want else f"only in Spark {list((got - want).items())[:3]}, only in SQL {list((want - got).items())[:3]}"
