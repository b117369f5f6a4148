"""Runs a registered query and its SQL and compares the rows."""

import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


def database(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())


def sql_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())
