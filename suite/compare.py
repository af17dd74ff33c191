"""Compare a query with its SQL: columns by name, rows as a multiset, values exactly."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _value(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(r[i]).__name__, _value(r[i])) for i in order) for r in data)


def check(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    got_cols, got_rows = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    got, want = rows(got_cols, got_rows), rows(want_cols, cur.fetchall())
    if got != want:
        return (f"rows {sum(got.values())} vs {sum(want.values())}; only spark {list((got - want).items())[:3]}; "
                f"only sql {list((want - got).items())[:3]}")
    return None
