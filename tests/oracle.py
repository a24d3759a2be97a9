"""Runs SQL on the driver's tables in DuckDB and compares rows without order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        c.execute(f"create view {t} as select * from '{path}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.6g}"
    return f"{x:.6g}" if type(x).__name__ == "Decimal" else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(df, sql, sf_dir):
    c = connect(sf_dir).execute(sql)
    names = [d[0] for d in c.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(names, c.fetchall())
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, bad[:3]
