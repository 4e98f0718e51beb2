"""Rows of a query held against its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def connect(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def same(value):
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


def differences(df, connection, sql):
    columns = sorted(df.columns)
    answer = connection.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(repr([same(r[names.index(c)]) for c in columns]) for r in answer.fetchall())
    found = sorted(repr([same(r[c]) for c in columns]) for r in df.collect())
    return found, want
