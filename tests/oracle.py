"""Holds queries against their SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:19]
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return round(x, 6) if isinstance(x, float) else x


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return [rel.columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
