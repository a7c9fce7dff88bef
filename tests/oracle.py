"""Compares a query with its SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF)


def connect(sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return repr(v) if isinstance(v, float) else str(v)


def same(spark, query, sql, sf=SF):
    got = query(spark, sf)
    names = sorted(got.columns)
    rows = sorted([tuple(plain(r[c]) for c in names) for r in got.collect()], key=str)
    run = connect(sf).execute(sql)
    columns = [c[0] for c in run.description]
    assert sorted(columns) == names
    want = sorted([tuple(plain(r[columns.index(c)]) for c in names) for r in run.fetchall()], key=str)
    assert rows == want
