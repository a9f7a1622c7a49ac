"""Runs a query and its SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
DATA = "/root/testdata/sf0.001"


def connect(sf_dir: str = DATA):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows_of(df) -> list:
    cols = sorted(df.columns)
    return sorted(tuple(repr(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def rows_of_sql(connection, sql: str) -> tuple[list, list]:
    r = connection.sql(sql)
    cols = sorted(r.columns)
    return cols, sorted(tuple(repr(v) for v in x) for x in r.select(*[f'"{c}"' for c in cols]).fetchall())
