"""Runs a query's SQL counterpart in DuckDB over the same Parquet tables and compares rows."""

from __future__ import annotations

import math
import os
from datetime import date, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of_frame(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)


def rows_of_sql(con, sql):
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


def assert_same(frame, sf_dir: str, sql: str) -> int:
    names, rows = rows_of_frame(frame)
    sql_names, sql_rows = rows_of_sql(connect(sf_dir), sql)
    assert names == sql_names
    assert len(rows) == len(sql_rows), (len(rows), len(sql_rows))
    for mine, theirs in zip(rows, sql_rows, strict=True):
        assert mine == theirs, (names, mine, theirs)
    return len(rows)
