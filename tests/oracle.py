"""Comparison of a Spark result with DuckDB's, row by row."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "shape", ()) != ():
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if x is None or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return 0.0 if x == 0 else x
    return str(x)[:10] if hasattr(x, "year") else x


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    rows = [tuple(plain(x) for x in r) for r in frame[names].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def difference(spark, sf_dir: str, query, sql: str) -> str:
    """What is not alike, empty if all is."""
    got = query(spark, sf_dir)
    left = pd.DataFrame([tuple(r) for r in got.collect()], columns=got.columns, dtype=object)
    res = connect(sf_dir).execute(sql)
    right = pd.DataFrame(res.fetchall(), columns=[d[0] for d in res.description], dtype=object)
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} and {sorted(right.columns)}"
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    a, b = rows_of(left), rows_of(right)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, as {bad[0]}" if bad else ""
