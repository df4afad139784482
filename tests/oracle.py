"""Compare a Spark result with the same question asked of DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(int(v)))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return (1, f"{float(v):.10g}")
    return (2, str(v))


def compare(df, con, sql: str) -> list[str]:
    """What differs; empty if the results are equal as multisets of rows."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    got = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    a, b = sorted(tuple(map(_norm, r)) for r in got), sorted(tuple(map(_norm, r)) for r in want)
    return [] if a == b else [f"{len(a)} rows and {len(b)}", *[f"{x} != {y}" for x, y in zip(a, b) if x != y][:2]]
