"""Comparison of a query with its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)

    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return float(v)

    return cols, sorted((tuple(map(plain, r)) for r in df[cols].astype(object).values.tolist()), key=str)


def check(spark, con, sf_dir, query, sql):
    got, want = rows(query(spark, sf_dir).toPandas()), rows(con.sql(sql).df())
    assert got == want
