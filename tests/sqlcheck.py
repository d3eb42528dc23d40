"""Runs a registered query on Spark and its SQL on DuckDB over the same tables and compares the rows."""

import math
import os

DATA = "/root/testdata/sf0.001"


def views(con, folder=DATA):
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        at = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{at}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, query, sql, folder=DATA):
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want, ([x for x in got if x not in want][:3], [x for x in want if x not in got][:3])
