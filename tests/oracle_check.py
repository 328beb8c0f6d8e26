"""Compare a Spark result with its SQL twin, row by row after sorting."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.6f}" if value else "0.000000"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def mismatch(spark_df, sql: str, connection) -> str | None:
    """None when equal, else a short description."""
    cursor = connection.execute(sql)
    columns = [c[0] for c in cursor.description]
    types = {c[0]: str(c[1]) for c in cursor.description}
    want = _rows(columns, cursor.fetchall())
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(columns)}"
    got = _rows(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = [
        f"{name}: {kind} against {types[name]}" for name, kind in spark_df.dtypes
        if kinds.get(kind, kind) != types[name]
    ]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; types {wrong}"
    different = [(g, w) for g, w in zip(got, want) if g != w]
    if different:
        return f"{len(different)} of {len(want)} rows differ, first {different[0]}; types {wrong}"
    return f"types {wrong}" if wrong else None
