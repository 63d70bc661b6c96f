"""Compare a query's rows with those of its SQL in DuckDB."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return plain(float(value)) if value % 1 else int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return value


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[n]) for n in names]) for r in df.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr([plain(row[i]) for i in order]) for row in result.fetchall())
