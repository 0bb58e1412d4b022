"""Compare a query's rows with DuckDB's, whatever their order."""

import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def check(df, con, sql):
    columns = sorted(df.columns)
    ours = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = Counter(repr([plain(row[names.index(c)]) for c in columns]) for row in got.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:2], list((theirs - ours).items())[:2])
