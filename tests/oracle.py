"""Compares a query with its SQL in DuckDB: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def rows(columns: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for table in TABLES:
        if os.path.exists(f"{sf_dir}/{table}.parquet"):
            con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(df.columns)
    want, got = rows(names, out.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(want) == len(got), (len(want), len(got))
    wrong = [(a, b) for a, b in zip(want, got) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
