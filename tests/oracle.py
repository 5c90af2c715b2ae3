"""Comparison of a Spark query with its SQL in DuckDB."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v) if not isinstance(v, decimal.Decimal) else format(v, "f")


def spark_rows(df):
    names = sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def duck_rows(con, sql):
    found = con.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(c) for c in names]
    return names, sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def same(df, con, sql):
    names, rows = duck_rows(con, sql)
    assert names == sorted(df.columns)
    assert spark_rows(df) == rows
    return len(rows)
