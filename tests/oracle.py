"""Hold a query against its SQL on one scale of the tables."""

import os

import duckdb


def _plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return x.item() if hasattr(x, "item") else x


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    out = query(spark, sf_dir)
    columns = sorted(out.columns)
    ours = sorted((tuple(_plain(r[c]) for c in columns) for r in out.collect()), key=repr)
    rel = con.sql(sql)
    names = rel.columns
    assert sorted(names) == columns
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert ours == theirs
