"""Run a query and its SQL side by side."""

from __future__ import annotations

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, (datetime, date)):
        return str(x)
    if isinstance(x, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def spark_rows(df):
    names = df.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in df.collect()), key=repr)


def same(df, sql: str, sf_dir: str) -> None:
    a, b = spark_rows(df), duck_rows(sql, sf_dir)
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]))
    for x, y in zip(*[z[1] for z in (a, b)], strict=True):
        assert x == y, f"\nspark {x}\nsql   {y}"
