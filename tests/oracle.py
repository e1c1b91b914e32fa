"""Comparison of a Spark query with SQL over the same tables in DuckDB."""

import glob
import os

import duckdb
from pyspark.sql import functions as F


def tables(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


def same(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    dates = [n for n, t in got.dtypes if t == "date"]
    got = got.withColumns({n: F.col(n).cast("string") for n in dates}) if dates else got
    got, want = got.toPandas(), tables(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
