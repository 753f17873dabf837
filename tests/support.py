"""Runs a registered query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v: object, digits: int = 6) -> object:
    """A value of either engine in one comparable form."""
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, digits) + 0.0
    if isinstance(v, dict):
        return tuple(plain(x, digits) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(plain(x, digits) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x, digits) for x in v)
    return v


def duck(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def ordered(columns: list[str], rows: list) -> list[tuple]:
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def differences(df: DataFrame, sql: str, sf_dir: str) -> str:
    """An empty string where both give the same columns and rows."""
    columns, expected = duck(sql, sf_dir)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = ordered(df.columns, df.collect()), ordered(columns, expected)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} rows against {len(b)}; only in Spark {only_a}; only in SQL {only_b}"
