"""Side-by-side runs of a query and its DuckDB SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    if type(x).__name__ == "Decimal":
        return float(x)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def duck(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return sorted(names), rows_of(names, got.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def compare(spark, query, sql, sf):
    want_names, want = duck(sql, sf)
    got_names, got = spark_rows(query(spark, sf))
    assert got_names == want_names
    assert len(got) == len(want), (len(got), len(want))
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, (len(wrong), wrong[:3])
