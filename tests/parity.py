"""Compares a registered query with its SQL in DuckDB, column by column and row by row."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return None if v is None else str(v)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows_of_spark(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
