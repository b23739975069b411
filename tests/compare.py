"""Compares a query's rows with its SQL's, column by column, in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return x.isoformat() if hasattr(x, "isoformat") else float(x) if isinstance(x, (int,)) and not isinstance(x, bool) else x


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, db, sql: str) -> str | None:
    """None if both give the same rows."""
    got = rows_of(df.columns, df.collect())
    cursor = db.execute(sql)
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} of {len(got[1])} rows differ: {str(bad[:2])[:500]}" if bad else None
