"""Compares a query with its SQL: columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(Path(folder).iterdir()):
        if p.suffix == ".parquet":
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def plain(x):  # noqa: ANN001, ANN201
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows(names: list[str], found: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def difference(spark, folder: str, query, sql: str) -> str:  # noqa: ANN001
    """Empty if both sides agree, else the first rows that only one side has."""
    c = connect(folder)
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    df = query(spark, folder)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    if ours == theirs:
        return ""
    a, b = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
    return f"{len(ours)} and {len(theirs)} rows; only ours {a}; only SQL's {b}"
