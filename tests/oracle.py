"""Compare a query with its SQL on DuckDB: the same column names, the same rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, int):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def difference(df, sql: str, sf_dir: str) -> str:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = got.fetchall()
    ours = df.toArrow()
    if sorted(names) != sorted(ours.column_names):
        return f"columns {sorted(ours.column_names)} and {sorted(names)}"
    order = sorted(names)
    a = Counter(tuple(value(r[n]) for n in order) for r in ours.to_pylist())
    b = Counter(tuple(value(r[names.index(n)]) for n in order) for r in theirs)
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only ours {list((a - b).items())[:3]}; only theirs {list((b - a).items())[:3]}"
