"""Spark results against SQL results of DuckDB."""

import glob
import os
from collections import Counter

import duckdb


def connect(path):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{path}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return repr(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def same(df, con, sql):
    cur = con.execute(sql)
    cols = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(cols)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(cols, cur.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
