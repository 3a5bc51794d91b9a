"""Compares rows of Spark and DuckDB, in any order, by value."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

DATA = os.environ.get("EFFECTUM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection() -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    if isinstance(v, int | float) or type(v).__module__ == "numpy" and getattr(v, "ndim", 1) == 0:
        return repr(float(v))
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))
