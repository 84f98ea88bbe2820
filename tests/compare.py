"""A Spark query against its DuckDB twin: same columns, same rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 7) + 0.0)
    return str(v)


def rows(columns, found):
    return sorted(tuple(plain(x) for x in r) for r in found)


def same(spark, query, sql, folder):
    df = query(spark, folder)
    cols = sorted(df.columns)
    ours = rows(cols, df.select(*cols).collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = rows(cols, ([r[i] for i in at] for r in rel.fetchall()))
    assert ours == theirs
