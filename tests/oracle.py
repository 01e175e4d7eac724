"""Run a query and its SQL on the same tables and compare the rows."""

import glob
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def tidy(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def same(df, con, sql):
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    got = tidy(tuple(r) for r in df.select(*cols).collect())
    want = tidy(rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want
    return len(got)
