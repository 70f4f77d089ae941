"""Runs a query and its SQL and compares them whole, whatever the order of rows and columns."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(v)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(df, sql: str, sf_dir: str = DATA) -> int:
    con = duck(sf_dir).execute(sql)
    names = [d[0] for d in con.description]
    expected = rows_of(names, con.fetchall())
    got = rows_of(df.columns, df.collect())
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    assert len(got) == len(expected), (len(got), len(expected), got[:2], expected[:2])
    wrong = [(a, b) for a, b in zip(got, expected) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
    return len(got)
