"""Runs a query and its SQL over the same tables and compares the rows, in no order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    """A value as both engines give it."""
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if the query and its SQL agree."""
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; first got {got[:2]}, want {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"got {g}, want {w}"
    return ""
