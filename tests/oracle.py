"""Runs a query and its SQL on the same tables and compares rows, whatever their order."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


def duck(sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        files = glob.glob(f"{sf_dir}/{t}.parquet/*.parquet") or [f"{sf_dir}/{t}.parquet"]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else int(v) if type(v).__name__ == "Decimal" and v == int(v) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def check(spark, query, sql, sf_dir=DATA):
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert mine == rows(names, found.fetchall())
