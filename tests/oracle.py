"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(str, v)) + "]"
    if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() else f"{v:.6f}"
    return str(int(v)) if isinstance(v, (int, np.integer)) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(_cell, r)) for r in frame.itertuples(index=False, name=None))


def compare(spark, con, folder, query, sql):
    got, want = rows(query(spark, folder).toPandas()), rows(con.sql(sql).df())
    assert got == want
    return got[1]
