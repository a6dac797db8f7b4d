"""Compares a query with its DuckDB SQL on the driver's smallest tables."""

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def assert_same(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    a, b = query(spark, data).toPandas(), con.sql(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    shape = lambda f: f[cols].map(text).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(shape(a), shape(b), check_dtype=False)
