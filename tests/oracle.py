"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else 0.0 if value == 0 else value
    return value


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    table = frame.select(*[f"`{c}`" for c in columns]).toArrow()
    return columns, sorted((tuple(map(normal, row)) for row in zip(*[table.column(c).to_pylist() for c in columns], strict=True)), key=repr)


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    table = con.sql(sql).to_arrow_table()
    columns = sorted(table.column_names)
    return columns, sorted((tuple(map(normal, row)) for row in zip(*[table.column(c).to_pylist() for c in columns], strict=True)), key=repr)
