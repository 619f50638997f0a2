"""Rows in a form that Spark's and DuckDB's results share."""

import datetime
import decimal
import math

import duckdb

from sparkloom.session import TABLES


def canon(x):
    if x is None or isinstance(x, (bool, str)):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(map(canon, x))
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else int(x) if x == int(x) and abs(x) < 1e15 else round(x, 8)
    if isinstance(x, datetime.datetime):
        return str(x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con
