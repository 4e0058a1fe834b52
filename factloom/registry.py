"""Queries with the SQL that a second engine checks them by."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: str, values: list) -> str:
    """An expression for both engines: one of the values, by the key."""
    show = lambda v: "CAST(NULL AS STRING)" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"CASE CAST({key} % {len(values)} AS INT) " + " ".join(f"WHEN {i} THEN {show(v)}" for i, v in enumerate(values)) + " END"


def _sql(text: str) -> str:
    """DuckDB's lambdas are written ``x -> ...`` here."""
    return re.sub(r"\b(\w+) -> ", r"lambda \1: ", text.strip())


class Source:
    """Rows of a driver table through expressions that both engines read alike."""

    def __init__(self, table: str, **columns: str):
        self.table, self.columns = table, columns

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # backslashes in Spark's literals are escapes
        return read(spark, sf_dir, self.table).selectExpr(*[f"{e.replace(chr(92), chr(92) * 2)} AS {n}" for n, e in self.columns.items()])

    @property
    def sql(self) -> str:
        return f"SELECT {', '.join(f'{e} AS {n}' for n, e in self.columns.items())} FROM {self.table}"


def on(name: str, source: Source, oracle: str | None = None):
    """Register a function of one frame; the oracle reads the same rows as ``src``."""

    def register(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(source.frame(spark, sf_dir))
        if oracle:
            text = _sql(oracle)
            ORACLES[name] = f"WITH RECURSIVE src AS ({source.sql}), {text[5:]}" if text.upper().startswith("WITH ") else f"WITH src AS ({source.sql}) {text}"
        return f

    return register


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = _sql(oracle)
        return f

    return register
