"""Spark results against SQL in DuckDB, regardless of order."""

import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        path = os.path.join(folder, f)
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)) or type(x).__name__ == "Decimal":
        return f"{float(x):.9g}"
    return str(x)


def rows(frame):
    return sorted("|".join(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))
