"""Runs a query's SQL in DuckDB over the same tables and compares rows as a multiset."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[k]) for k in order) for r in got.fetchall())


def rows_of(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def differ(df, sql: str, sf_dir: str) -> str:
    """Empty if the rows are equal."""
    (a, x), (b, y) = rows_of(df), rows_of_sql(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        return f"{sum(x.values())} and {sum(y.values())} rows; only in Spark {list((x - y).items())[:3]}; only in SQL {list((y - x).items())[:3]}"
    return ""
