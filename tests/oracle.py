"""Runs a query on both engines and compares the rows, whatever their order."""

import datetime
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(x):
    if x is None or x is pd.NaT or (isinstance(x, (float, np.floating)) and x != x):
        return None
    if isinstance(x, (float, np.floating)):
        return round(float(x), 9)
    if isinstance(x, (datetime.date, np.datetime64)):
        return str(pd.Timestamp(x))
    return int(x) if isinstance(x, np.integer) else bool(x) if isinstance(x, np.bool_) else x


def _plain(df):
    columns = [[_value(x) for x in df[c].tolist()] for c in sorted(df.columns)]
    return sorted(zip(*columns), key=str)


def compare(spark_df, con, sql, tolerance=2e-6):
    got, want = _plain(spark_df.toPandas()), _plain(con.sql(sql).df())
    if len(got) != len(want):
        return f"{len(got)} rows, {len(want)} expected; {got[:2]} {want[:2]}"
    bad = 0
    for a, b in zip(got, want):
        if a != b:
            bad += 1
            if not all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= tolerance * max(1, abs(y))) for x, y in zip(a, b)):
                return f"{a} instead of {b}"
    return f"{bad} of {len(got)} rows differ in rounding" if bad else None
