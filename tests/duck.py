"""Rows of a DataFrame against DuckDB's SQL on the same tables."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def same_rows(df, sql, folder):
    ours, theirs = df.toPandas(), connect(folder).execute(sql).df()
    columns = sorted(ours.columns)
    assert sorted(theirs.columns) == columns
    plain = lambda x: sorted(repr(tuple(r)) for r in x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None))
    assert plain(ours) == plain(theirs)
