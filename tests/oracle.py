"""Run SQL over the parquet tables in DuckDB and compare rows without regard to order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.execute(sql).df()


def rows(df) -> list:
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(v, 9) if isinstance(v, float) else str(v)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


def same(spark_df, sql: str, sf_dir: str) -> None:
    a, b = spark_df.toPandas(), run(sql, sf_dir)
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
