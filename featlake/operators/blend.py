"""Level-2 matrices and blends of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.functions.numeric import clip


def _long(preds: dict[str, DataFrame], key: str, pred: str) -> DataFrame:
    frames = [f.select(key, F.col(pred).cast("double").alias("_p"), F.lit(name).alias("_model")) for name, f in preds.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def stack_matrix(preds: dict[str, DataFrame], key: str, pred: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """One row per key and one clipped column per model, by one shuffle whatever the number of models."""
    return (_long(preds, key, pred).groupBy(key)
            .agg(*[clip(F.max(F.when(F.col("_model") == m, F.col("_p"))), lo, hi).alias(m) for m in preds]))


def blend_mean(preds: dict[str, DataFrame], key: str, pred: str, out: str = "blend") -> DataFrame:
    return _long(preds, key, pred).groupBy(key).agg(F.avg("_p").alias(out))


def blend_weighted(df: DataFrame, weights: dict[str, float], out: str = "blend") -> DataFrame:
    """Linear combination of prediction columns."""
    return df.withColumn(out, sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)))


def blend_geometric(preds: dict[str, DataFrame], key: str, pred: str, out: str = "blend") -> DataFrame:
    """Geometric mean; 0 as soon as one prediction is not positive."""
    ln = F.avg(F.when(F.col("_p") > 0, F.log("_p")))
    return _long(preds, key, pred).groupBy(key).agg(
        F.when(F.min("_p") <= 0, F.lit(0.0)).otherwise(F.exp(ln)).alias(out))


def row_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Largest, smallest and middle value of the row over some columns, and largest minus middle; nulls are skipped."""
    arr = F.array_sort(F.array_compact(F.array(*[F.col(c).cast("double") for c in cols])))
    n = F.size("_a")
    at = lambda i: F.try_element_at("_a", i.cast("int"))
    return (df.withColumn("_a", arr)
            .withColumn("row_max", F.array_max("_a")).withColumn("row_min", F.array_min("_a"))
            .withColumn("row_median", (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)
            .withColumn("row_max_median", F.col("row_max") - F.col("row_median")).drop("_a"))
