"""Where query modules put their queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL over the test tables if SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparing results across engines."""
    return df.select(*[df[c].cast("double").alias(c) if t.startswith("decimal") else df[c] for c, t in df.dtypes])
