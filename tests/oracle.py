"""Runs a query and its SQL on the same tables and compares the rows."""

import datetime
import decimal
import glob
import numbers
import os

import duckdb


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (numbers.Number, decimal.Decimal)):
        return float(f"{float(x):.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x) if isinstance(x, (datetime.datetime, datetime.date)) else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in values)


def tables(directory):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{directory}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def same(spark, connection, query, sql, directory):
    df = query(spark, directory)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    want_columns = [x[0] for x in result.description]
    assert sorted(df.columns) == sorted(want_columns)
    assert got == rows(want_columns, result.fetchall())
    return len(got)
