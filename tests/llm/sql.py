"""Compares a query with its SQL on the same tables."""

import os

import duckdb


def same(df, sql, sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        path = f"{sf}/{t}/*.parquet" if os.path.isdir(f"{sf}/{t}") else f"{sf}/{t}"
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({sql}) t").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return len(got)
