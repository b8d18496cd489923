"""A Spark result beside DuckDB's, as sorted rows of text."""

import os

import duckdb
import pandas as pd


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con.execute(sql).df()


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    c = sorted(df.columns)
    return df[c].sort_values(c).reset_index(drop=True).astype(str)
