"""Compares a query's rows with those of SQL in DuckDB over the same files."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def ordered(names: list[str], rows) -> list[tuple]:
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if equal, else the first difference."""
    names, rows = sql_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = ordered(df.columns, df.collect()), ordered(names, rows)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return "" if not bad else f"{len(bad)} of {len(a)} rows differ, as {sorted(df.columns)}: {str(bad[0])[:1500]}"
