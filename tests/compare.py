"""Compares a registered query with its SQL, column by column and value by value."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float) and value != value:
        return "NaN"
    return value


def _sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, repr(v)) for v in row))


def differences(spark, build, sql: str, folder: str, db=None) -> list[str]:
    """What differs, empty when nothing does."""
    db = db or connect(folder)
    df = build(spark, folder)
    answer = db.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    mine = _sorted_rows(df.columns, df.collect())
    theirs = _sorted_rows(names, answer.fetchall())
    if len(mine) != len(theirs):
        return [f"{len(mine)} rows against {len(theirs)}"]
    return [f"{a} against {b}" for a, b in zip(mine, theirs) if repr(a) != repr(b)]
