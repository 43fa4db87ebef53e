"""Holds a query's rows against DuckDB's for the same SQL."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.8g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(columns, data, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple(plain(r[k]) for k in at) for r in data)


def same(df, sql, con):
    got = df.collect()
    want = con.sql(sql)
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert rows(df.columns, got, order) == rows(want.columns, want.fetchall(), order)
