"""Compare a query with its SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x: object) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return ""
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_plain, r)) for r in df.itertuples(index=False))


def assert_equal(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b, (list(set(a) - set(b))[:3], list(set(b) - set(a))[:3])
