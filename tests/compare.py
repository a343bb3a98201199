"""Comparison of a Spark result with DuckDB's, whatever the order of rows and columns."""

import glob
import os

import duckdb


def cell(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, float):
        return str(round(value, 6) + 0.0) if value != int(value) else str(int(value))
    return str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(cell(v) for v in row) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


def duck(sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con.sql(sql).df()
