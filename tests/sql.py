"""Compares a query with its SQL on the same tables."""

import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        path = f"{sf}/{t}/*.parquet" if os.path.isdir(f"{sf}/{t}") else f"{sf}/{t}"
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def same(df, sql, con):
    cols = sorted(df.columns)
    want = [tuple(map(_plain, r)) for r in con.execute(f"select {', '.join(cols)} from ({sql}) t").fetchall()]
    got = [tuple(map(_plain, r)) for r in df.select(*cols).collect()]
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:3]
        raise AssertionError(f"{len(got)} rows against {len(want)}; {cols}; first differing: {odd}")
    return len(got)
