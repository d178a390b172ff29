"""Error measures, AUC and correlations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.operators.blocks import summed
from featlake.operators.quantiles import prefix_sums


def rmse_by_fold(df: DataFrame, y: str, p: str, fold: str) -> DataFrame:
    """RMSE per fold beside the mean over the folds."""
    per = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(fold).agg(
        F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))).alias("rmse"))
    return per.withColumn("mean_rmse", per.agg(F.avg("rmse")).scalar())


def rmsle(df: DataFrame, y: str, p: str) -> DataFrame:
    """Root mean squared difference of log1p values; a prediction below 0 counts as 0."""
    d = F.log1p(F.col(y)) - F.log1p(F.greatest(F.col(p), F.lit(0.0)))
    return df.agg(F.sqrt(F.avg(d * d)).alias("rmsle"))


def auc_by(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """ROC-AUC per group from mean ranks of the distinct scores; null with one class only."""
    counts = (df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, p)
              .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("_pos")))
    ranked = prefix_sums(counts, by, p)
    rank = F.col("before") + (F.col("n") + 1) / 2.0
    pos, all_ = F.col("_p"), F.col("_n")
    return (ranked.groupBy(*by).agg(F.sum("_pos").alias("_p"), F.sum("n").alias("_n"), F.sum(F.col("_pos") * rank).alias("_s"))
            .select(*by, F.try_divide(F.col("_s") - pos * (pos + 1) / 2.0, pos * (all_ - pos).cast("double")).alias("auc")))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, long form, over the rows that have both; null without spread.

    Two passes, means and then products of blocks of rows; p columns make sums of p x p numbers in a task and on the driver.
    """
    p = len(cols)

    def firsts(x: np.ndarray) -> np.ndarray:
        ok = ~np.isnan(x)
        return np.concatenate([ok.sum(axis=0), np.where(ok, x, 0).sum(axis=0)]).astype(float)

    def whole(fn, width: int) -> np.ndarray:
        out = np.zeros(width)
        for r in summed(df, cols, fn).collect():
            out[r["at"]] = r["v"]
        return out

    n, s = whole(firsts, 2 * p).reshape(2, p)
    mean = np.divide(s, n, out=np.zeros(p), where=n > 0)

    def seconds(x: np.ndarray) -> np.ndarray:
        ok = (~np.isnan(x)).astype(float)
        z = np.where(ok > 0, x - mean, 0)
        return np.concatenate([m.ravel() for m in (ok.T @ ok, z.T @ z, z.T @ ok, (z * z).T @ ok)])

    n, xy, x, xx = whole(seconds, 4 * p * p).reshape(4, p, p)
    n1 = np.maximum(n, 1)
    cov, var = xy - x * x.T / n1, xx - x * x / n1
    spread = np.sqrt(np.maximum(var, 0) * np.maximum(var.T, 0))
    rows = [(cols[i], cols[j], float(cov[i, j] / spread[i, j]) if spread[i, j] > 0 else None) for i in range(p) for j in range(i, p)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")
