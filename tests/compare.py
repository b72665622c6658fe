"""Results of a query and of SQL as comparable rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


def both(spark, query, sql, folder):
    df = query(spark, folder)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    found = database(folder).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    return mine, rows(names, found.fetchall())
