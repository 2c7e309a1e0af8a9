"""Comparison of a query with its SQL, and small builders."""

from __future__ import annotations

import hashlib
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(sql, sf=SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    got = con.execute(sql)
    return table([c[0] for c in got.description], got.fetchall())


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def files(spark, named: dict[str, bytes]):
    return spark.createDataFrame([(n, bytearray(b)) for n, b in named.items()], "source_name string, body binary")
