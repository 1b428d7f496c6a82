"""Comparison of a query with its SQL twin in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def as_rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(made, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r))


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    found = as_rows(df.columns, df.collect())
    result = con.execute(sql)
    wanted = as_rows([c[0] for c in result.description], result.fetchall())
    assert found[0] == wanted[0], (found[0], wanted[0])
    assert len(found[1]) == len(wanted[1]), (len(found[1]), len(wanted[1]))
    for a, b in zip(found[1], wanted[1]):
        assert a == b, (a, b)
    return len(found[1])
