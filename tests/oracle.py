"""Comparing queries with their SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.sql("set TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.sql(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def same_rows(df, relation) -> None:
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    ours = sorted(repr([row[n] for n in names]) for row in df.collect())
    theirs = sorted(repr([row[i] for i in at]) for row in relation.fetchall())
    assert ours == theirs
