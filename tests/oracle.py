"""Holds a query's rows against DuckDB's."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import numpy as np
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(x):
    if x is None or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return float(x)
    if isinstance(x, (float, np.floating, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(norm(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, norm(v)) for k, v in x.items())
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    mine = [tuple(norm(r[c]) for c in order) for r in df.collect()]
    at = [names.index(c) for c in order]
    theirs = [tuple(norm(r[i]) for i in at) for r in theirs]
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    a, b = sorted(mine, key=repr), sorted(theirs, key=repr)
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{x} and {y}"
    return None if mine else "no rows"
