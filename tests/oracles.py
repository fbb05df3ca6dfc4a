"""Run a query on Spark and its SQL on DuckDB over the same tables, and compare the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def same_rows(spark, query, sql, sf_dir=SF):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    ours, theirs = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    spark.catalog.clearCache()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    text = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert text(ours) == text(theirs)
    return ours
