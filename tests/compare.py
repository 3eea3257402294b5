"""Order-blind comparison of a Spark result with a DuckDB one."""

import datetime
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _text(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, (np.ndarray, list, tuple)):
        return "[" + ",".join(map(_text, v)) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() else f"{v:.9g}"
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(v))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted("|".join(map(_text, r)) for r in df.itertuples(index=False, name=None))
