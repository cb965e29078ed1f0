"""Spark's rows beside DuckDB's on the same tables, without order."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, bool):
        return repr(v)
    if hasattr(v, "as_tuple") or isinstance(v, (int, float)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, name, query, sql):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = query(spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns), name
    assert got == rows_of(columns, cur.fetchall()), name
