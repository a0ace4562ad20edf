"""Comparison of a query's rows with those of its standard SQL, whatever the order."""

import glob
import os

import pandas as pd

DATA = "/root/testdata/sf0.001"


def connection(folder: str = DATA):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def text(x) -> str:
    if x is None or x is pd.NaT or x != x:
        return ""
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    return str(x)


def rows(columns, data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(text(r[i]) for i in order) for r in data)


def same(spark, con, query, sql: str) -> None:
    df, rel = query(spark, DATA), con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
