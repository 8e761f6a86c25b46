"""A query's rows beside those of its SQL in DuckDB."""

import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as from '{sf_dir}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)


def rows_of_spark(df, columns):
    return sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(c, sql, columns):
    q = c.sql(sql)
    at = [q.columns.index(x) for x in columns]
    return sorted(tuple(plain(r[i]) for i in at) for r in q.fetchall())


def same(spark, query, sql, sf_dir):
    df, c = query(spark, sf_dir), connect(sf_dir)
    columns = sorted(df.columns)
    assert columns == sorted(c.sql(sql).columns)
    got, want = rows_of_spark(df, columns), rows_of_sql(c, sql, columns)
    assert len(got) == len(want)
    assert got == want
