"""Run queries in Spark and their SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import glob
import os
import sys

import duckdb
import pandas as pd

DATA = os.environ.get("FACTLOOM_DATA", "/root/testdata/sf0.001")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(_cell(x)) for x in v) + "]"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}" if abs(float(v)) < 1e15 else str(v)
    return str(v)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    names = sorted(pdf.columns)
    return sorted((tuple(_cell(v) for v in r) for r in pdf[names].itertuples(index=False, name=None)), key=str)


def differences(spark, name: str, f, sql: str, sf_dir: str) -> str | None:
    got = f(spark, sf_dir).toPandas()
    want = duck(sf_dir).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        first = next((f"{x} / {y}" for x, y in zip(a, b, strict=False) if x != y), "")
        return f"{name}: {len(a)} and {len(b)} rows; {first}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = e.queries(), e.oracle_sql()
    for n in [n for n in queries if any(n.startswith(p) for p in sys.argv[1:])]:
        try:
            said = differences(spark, n, queries[n], oracles[n], DATA) if n in oracles else f"{n}: no SQL, {queries[n](spark, DATA).count()} rows"
        except Exception as err:
            said = f"{n}: {type(err).__name__} {str(err)[-700:]}"
        print("@@", said or f"{n}: ok", flush=True)
