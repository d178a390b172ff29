"""Date column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weekday(col: Column) -> Column:
    """Monday = 0."""
    return F.weekday(col)


def calendar_parts(col: Column, prefix: str = "") -> list[Column]:
    parts = {"year": F.year, "day_of_year": F.dayofyear, "week": F.weekofyear, "day": F.dayofmonth, "quarter": F.quarter}
    return [fn(col).alias(prefix + name) for name, fn in parts.items()]


def days_between(a: Column, b: Column) -> Column:
    """Whole days from ``b`` to ``a``."""
    return F.datediff(a, b)


def fill_date(col: Column, default: str) -> Column:
    return F.coalesce(col, F.to_date(F.lit(default)))


def end_weekday(df: DataFrame, date_to: str, out: str = "end_weekday") -> DataFrame:
    return df.withColumn(out, F.weekday(date_to))


def expand_dates(df: DataFrame, date_from: str, date_to: str, out: str = "day") -> DataFrame:
    """One row per day of [from, to]; a range that ends before it starts gives no row."""
    return df.where(F.col(date_to) >= F.col(date_from)).withColumn(
        out, F.explode(F.sequence(date_from, date_to)))
