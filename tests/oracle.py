"""Holds a query's rows against its SQL on the same tables, without regard to order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if equal."""
    got = df.select(*sorted(df.columns)).collect()
    rel = connect(sf_dir).execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = [names.index(c) for c in sorted(names)]
    want = Counter(tuple(_plain(r[i]) for i in order) for r in rel.fetchall())
    have = Counter(tuple(map(_plain, r)) for r in got)
    if have == want:
        return ""
    return f"{sum(have.values())} and {sum(want.values())} rows; only Spark: {list((have - want).items())[:2]}; only SQL: {list((want - have).items())[:2]}"
