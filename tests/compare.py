"""Run a registered query and its SQL twin on the same tables and compare whole results."""

from __future__ import annotations

import glob
import os

import duckdb


def sql_connection(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def sql_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
