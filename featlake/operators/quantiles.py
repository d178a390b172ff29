"""Exact grouped quantiles and prefix sums that never hold one group in one task.

Rows are first reduced to distinct (keys, value) with their counts, which combines map-side. Those are sorted by Spark's
range partitioning, so a key with many values spans several partitions wherever its values lie; a table with one line
per partition and key then supplies what comes before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.session import settle


def value_counts_by(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Distinct (keys, value) with row count ``n``; null keys, null and NaN values are left out."""
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(ok).groupBy(*keys, value).agg(n.alias("n"))


def ordered_parts(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """The rows settled in ``order`` with their range partition ``_part``, which rises with the order."""
    return settle(df.sort(*order).withColumn("_part", F.spark_partition_id()))


def prefix_sums(counts: DataFrame, keys: list[str], value: str, weight: str = "n", out: str = "before",
                descending: bool = False, total: str | None = None) -> DataFrame:
    """``out`` = sum of ``weight`` over the rows of the same key that come strictly earlier in value order.

    ``counts`` holds each (keys, value) once. ``total`` names an extra column with the key's whole sum.
    """
    flip = F.desc if descending else F.asc
    parts = ordered_parts(counts, [*keys, flip(value)])
    grp = Window.partitionBy(*keys)
    offsets = (parts.groupBy(*keys, "_part").agg(F.sum(weight).alias("_w"))
               .withColumn("_off", F.coalesce(F.sum("_w").over(grp.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("_all", F.sum("_w").over(grp)).drop("_w"))
    inner = Window.partitionBy(*keys, "_part").orderBy(flip(value)).rowsBetween(Window.unboundedPreceding, -1)
    res = parts.withColumn(out, F.coalesce(F.sum(weight).over(inner), F.lit(0))).join(offsets, [*keys, "_part"])
    return res.select(*counts.columns, (F.col("_off") + F.col(out)).alias(out), *([F.col("_all").alias(total)] if total else []))


def grouped_quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5, out: str = "median",
                     weight: str | None = None, count: str | None = None) -> DataFrame:
    """Exact interpolated quantile of ``value`` per key, skipping nulls and NaN.

    ``weight`` counts a row several times, ``count`` names an extra column with the number of values.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_n"))
    counts = value_counts_by(rows, keys, "_v", F.col("_n"))
    ranked = prefix_sums(counts, keys, "_v", out="_beg", total="_all")
    pos = (F.col("_all") - 1) * F.lit(float(q))
    at = lambda r: F.max(F.when((F.col("_beg") <= r) & (r < F.col("_beg") + F.col("n")), F.col("_v")))
    res = ranked.groupBy(*keys).agg(at(F.floor(pos)).alias("_lo"), at(F.ceil(pos)).alias("_hi"), F.max(pos - F.floor(pos)).alias("_f"), F.max("_all").alias("_all"))
    return res.select(*keys, *([F.col("_all").alias(count)] if count else []),
                      F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
                      .otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(out))


def grouped_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    return grouped_quantile(df, keys, value, 0.5, out)


def column_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the exact median of every column, in one pass over the data."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in cols])).alias("s")).select("s.*")
    med = grouped_median(long, ["_c"], "_v", "_m")
    return med.agg(*[F.max(F.when(F.col("_c") == c, F.col("_m"))).alias(c) for c in cols])
