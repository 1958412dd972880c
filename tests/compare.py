"""Spark result against DuckDB result, as sorted rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def sort_key(row: tuple) -> tuple:
    return tuple(
        (value is not None, f"{value:.4f}" if isinstance(value, float) else str(value))
        for value in row
    )


def same(a, b) -> bool:
    """Equal, or one unit apart in the sixth decimal: engines round a tie either way."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b and (a is None) == (b is None)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when the results agree, else what differs first."""
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    position = [names.index(name) for name in order]
    expected = sorted((tuple(r[i] for i in position) for r in result.fetchall()), key=sort_key)
    actual = sorted((tuple(r) for r in df.select(*order).collect()), key=sort_key)
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    for mine, theirs in zip(actual, expected, strict=True):
        if not all(same(a, b) for a, b in zip(mine, theirs, strict=True)):
            return f"{order}: {mine} != {theirs}"
    return None
