"""Holds queries against their SQL on one data folder, as the driver does: rows by column name, in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else 0.0 if value == 0 else float(f"{value:.9g}")
    if isinstance(value, datetime.date | datetime.datetime):
        return value.isoformat()
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def difference(spark, con, sf: str, query, sql: str) -> str:
    """Empty if both agree."""
    df = query(spark, sf)
    got, names = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want, wanted = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != wanted:
        return f"columns {names} and {wanted}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, as {bad[0]}" if bad else ""
