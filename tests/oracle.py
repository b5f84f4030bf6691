"""Rows of a query and of its SQL, in one form."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def rows_of(df):
    columns = sorted(df.columns)
    return columns, _sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, _sorted(tuple(_plain(r[i]) for i in at) for r in found.fetchall())
