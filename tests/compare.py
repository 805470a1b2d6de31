"""Runs a query on Spark and its SQL on DuckDB and compares columns, kinds and rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(path: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{path}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    return v


def kind(v) -> str:
    if isinstance(v, bool):
        return "bool"
    return {int: "int", float: "float", str: "str"}.get(type(v), type(v).__name__)


def ordered(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def diff(df, oracle: str, path: str) -> str | None:
    con = duck(path)
    rel = con.execute(oracle)
    want_cols, want = ordered([d[0] for d in rel.description], rel.fetchall())
    got_cols, got = ordered(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = lambda rows: [{kind(r[i]) for r in rows if r[i] is not None} for i in range(len(got_cols))]
    if kinds(got) != kinds(want):
        return f"kinds {list(zip(got_cols, kinds(got), kinds(want)))}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cols = [(c, a, b) for c, a, b in zip(got_cols, g, w) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, first {g[:3]}: {cols}"
    return None
