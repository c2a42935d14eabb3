"""Spark results against DuckDB over the same tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    def plain(v):
        if v is None or (not isinstance(v, (list, np.ndarray, dict)) and pd.isna(v)):
            return None
        if isinstance(v, (float, int, np.floating, np.integer)) and not isinstance(v, bool):
            return repr(round(float(v), 6))
        return str(v)

    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=str)
