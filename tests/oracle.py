"""Comparing a query with its SQL on DuckDB: columns by name, rows in any order."""

from __future__ import annotations

import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def value(v: object) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(int(v)) if v == int(v) else repr(v)
    return str(v)


def rows(names: list[str], data: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in data)


def of_spark(df) -> tuple[list[str], list[tuple]]:
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    return rows([c[0] for c in cur.description], cur.fetchall())
