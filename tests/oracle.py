"""Runs a query and its oracle and says how they differ."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    return round(x, 9) + 0.0 if isinstance(x, float) else int(x) if hasattr(x, "__index__") and not isinstance(x, bool) else x


def difference(df, c: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if rows, columns and types' families agree."""
    got, want = df.toArrow(), c.sql(sql).to_arrow_table()
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return f"columns {names} and {sorted(want.column_names)}"
    kinds = [(n, str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in names]
    if odd := [k for k in kinds if k[1].replace("large_", "") != k[2].replace("large_", "")]:
        return f"types {odd}"
    rows = lambda t: sorted((tuple(plain(v) for v in r) for r in zip(*(t.column(n).to_pylist() for n in names), strict=True)), key=repr)
    a, b = rows(got), rows(want)
    if a != b:
        odd = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"{len(a)} and {len(b)} rows; first difference {odd}"
    return ""
