"""Comparison of a Spark query with its SQL on the same Parquet tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in at)) for r in rows)


def agree(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    rel = con.execute(sql)
    names, want = [c[0] for c in rel.description], rel.fetchall()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(names)
    a, b = _rows(df.columns, got), _rows(names, want)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:3]
    assert a
