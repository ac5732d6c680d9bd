"""Runs a query in Spark and its statement in DuckDB over the same tables and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def check(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    ours = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(norm(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall())
    assert ours == theirs
