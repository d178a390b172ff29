"""Registry of queries: name -> callable(spark, sf_dir), and name -> checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it is checked by tests on small frames instead."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(col: Column | str) -> Column:
    """Round to 6 decimals: float sums depend on the order of the partitions."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def round_doubles(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals."""
    return df.select(*[r6(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
