"""Row-by-row comparison of a Spark result with DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
from pyspark.sql import DataFrame


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def sorted_rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, str(v)) for v in row))


def spark_rows(df: DataFrame) -> list[tuple]:
    return sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con: duckdb.DuckDBPyConnection, query: str) -> tuple[list[str], list[str], list]:
    found = con.execute(query)
    names = [d[0] for d in found.description]
    kinds = [str(d[1]) for d in found.description]
    return names, kinds, sorted_rows(names, found.fetchall())


# DuckDB type of each Spark type in the reports.
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def difference(con: duckdb.DuckDBPyConnection, query: str, df: DataFrame) -> str | None:
    """None when columns, types and all values agree, else what differs first."""
    names, kinds, expected = duck_rows(con, query)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want = dict(zip(names, kinds))
    for name, kind in df.dtypes:
        if SAME_TYPE.get(kind) != want[name]:
            return f"type of {name}: {kind} != {want[name]}"
    got = spark_rows(df)
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    for mine, other in zip(got, expected):
        if mine != other:
            return f"{mine}\n!= {other}"
    return None
