"""Comparison of queries with their SQL run by DuckDB over the same files."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(folder + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _value(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_value, v)) + "]"
    return str(v) if hasattr(v, "isoformat") else repr(v)


def _table(rows):
    return sorted(tuple(map(_value, r)) for r in rows)


def same(df, con, sql):
    columns = sorted(df.columns)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = _table([[r[i] for i in order] for r in result.fetchall()])
    assert _table(df.select(*[f"`{c}`" for c in columns]).collect()) == want
