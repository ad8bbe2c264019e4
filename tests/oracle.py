"""Run a registered query and its SQL over the same tables and compare rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def canonical(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int):
        return float(x) if abs(x) < 2**53 else x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(canonical, x))
    if isinstance(x, dict):
        return tuple((k, canonical(v)) for k, v in x.items())
    return x


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{src}'")
    return con


def compare(spark, sf: str, query, sql: str) -> tuple[int, str]:
    """(rows, difference or '')."""
    df = query(spark, sf)
    names = sorted(df.columns)
    got = Counter(tuple(canonical(r[c]) for c in names) for r in (x.asDict(recursive=True) for x in df.collect()))
    con = duck(sf)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != names:
        return sum(got.values()), f"columns {names} against {sorted(cols)}"
    order = [cols.index(c) for c in names]
    want = Counter(tuple(canonical(r[i]) for i in order) for r in rel.fetchall())
    if got == want:
        return sum(got.values()), ""
    more, less = got - want, want - got
    return sum(got.values()), f"{sum(got.values())} against {sum(want.values())} rows; only Spark {list(more)[:3]}; only SQL {list(less)[:3]}"
