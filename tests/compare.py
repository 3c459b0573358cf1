"""Holds queries against their SQL: column names, rows, values, order aside."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x) if x != x.to_integral_value() else int(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list:
    """Nothing if both have the same columns and rows, else a few that differ."""
    other = con.execute(sql)
    names = [d[0] for d in other.description]
    if sorted(names) != sorted(df.columns):
        return [sorted(df.columns), sorted(names)]
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, other.fetchall())
    return [] if a == b else [len(a), len(b), *[(x, y) for x, y in zip(a, b, strict=False) if x != y][:3]]
