"""Holds a query's rows against those of its DuckDB SQL, as the driver does."""

from __future__ import annotations

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def value(x):
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, int):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return str(x)


def rows(table) -> list[str]:
    cols = sorted(table.column_names)
    return sorted(repr(tuple(map(value, r))) for r in zip(*(table.column(c).to_pylist() for c in cols))), cols
