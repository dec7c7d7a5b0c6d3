"""Runs a registered query and its SQL on the same tables and compares their rows."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def rows(records):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in records), key=repr)


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*cols).collect())
    rel = connect(sf_dir).sql(sql)
    assert sorted(rel.columns) == cols, (name, sorted(rel.columns), cols)
    want = rows(rel.select(*(f'"{c}"' for c in cols)).fetchall())
    assert len(got) == len(want), (name, len(got), len(want))
    assert got == want, (name, next((a, b) for a, b in zip(got, want) if a != b))
    return len(got)
