"""Compares a query with its SQL on the driver's tables."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in table), key=repr)


def differences(spark, sf_dir, query, sql):
    """Columns and first rows in which the two differ; empty if none."""
    frame = query(spark, sf_dir)
    got = frame.collect()
    want = connect(sf_dir).execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(frame.columns):
        return [("columns", sorted(frame.columns), sorted(names))]
    a, b = rows(frame.columns, [tuple(r) for r in got]), rows(names, want.fetchall())
    if len(a) != len(b):
        return [("rows", len(a), len(b))]
    return [(sorted(names), x, y) for x, y in zip(a, b, strict=True) if x != y][:3]
