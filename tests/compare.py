"""Compare a Spark frame with DuckDB SQL over the same tables: column names, and rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def same(df, sql: str, sf_dir: str) -> None:
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    got = [tuple(r) for r in df.collect()]
    a, b = rows(df.columns, got), rows(names, want)
    assert len(a) == len(b), (len(a), len(b), a[:3], b[:3])
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, (len(wrong), wrong[:3])
