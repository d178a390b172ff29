"""Topics of (row, column, count) cells by variational Bayes, as joins and sums over the cell table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.functions.numeric import stable_hash
from featlake.operators.sparse import added, mapped
from featlake.session import settle


def digamma(x: np.ndarray) -> np.ndarray:
    """Logarithmic derivative of the gamma function for positive numbers: raised above 6 by its recurrence, then its asymptotic series."""
    out, x = np.zeros_like(x), x.copy()
    for _ in range(6):
        low = x < 6
        out -= np.where(low, 1 / x, 0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _first(key: Column, topic: int, seed: int) -> Column:
    """Starting weight of a column in a topic, between 0.5 and 1.5, from a hash."""
    return 0.5 + (F.pmod(stable_hash(F.concat(F.lit(f"{seed}|{topic}|"), key.cast("string"))), F.lit(1000)) + 0.5) / 1000.0


def topic_shares(cells: DataFrame, row: str, col: str, value: str, k: int, iters: int = 20, tol: float = 1e-4, seed: int = 1,
                 alpha: float | None = None, eta: float | None = None) -> DataFrame:
    """(row, share0, share1, ...): topic shares of every row, after ``iters`` rounds or when no share moves by more than ``tol``.

    A round spreads each cell over the topics by the current weights of its row and column, and adds the spread cells up by row and by column; a row or
    column with very many cells is summed by many tasks. ``alpha`` and ``eta`` are the priors of rows and columns (1/k each). Cells without a positive value are left out.
    """
    a, e = (1.0 / k if p is None else p for p in (alpha, eta))
    ks = range(k)
    c = settle(cells.select(F.col(row).alias("row"), F.col(col).alias("col"), F.col(value).cast("double").alias("n")).where("n > 0"))
    rows = settle(c.select("row").distinct().select("row", *[F.lit(a + 1.0).alias(f"g{i}") for i in ks]))
    cols = settle(c.select("col").distinct().select("col", *[_first(F.col("col"), i, seed).alias(f"l{i}") for i in ks]))
    for _ in range(iters):
        total = added(cols, {"l": k}, lambda t: t["l"].sum(axis=0))
        by_row = mapped(rows, ["row"], {"g": k}, lambda t: {"r": np.exp(digamma(t["g"]) - digamma(t["g"].sum(axis=1, keepdims=True)))}, {"r": k})
        by_col = mapped(cols, ["col"], {"l": k}, lambda t, total=total: {"t": np.exp(digamma(t["l"]) - digamma(total))}, {"t": k})
        whole = sum((F.col(f"r{i}") * F.col(f"t{i}") for i in ks), F.lit(0.0))
        spread = settle(c.join(settle(by_row), "row").join(settle(by_col), "col").withColumn("w", F.col("n") / (whole + 1e-100))
                        .select("row", "col", *[(F.col("w") * F.col(f"r{i}") * F.col(f"t{i}")).alias(f"p{i}") for i in ks]))
        new = spread.groupBy("row").agg(*[(F.sum(f"p{i}") + a).alias(f"n{i}") for i in ks])
        both = settle(rows.join(new, "row"))
        cols = settle(spread.groupBy("col").agg(*[(F.sum(f"p{i}") + e).alias(f"l{i}") for i in ks]))

        def moved(t: dict) -> np.ndarray:
            old, now = (t[x] / t[x].sum(axis=1, keepdims=True) for x in ("g", "n"))
            return np.array([(np.abs(now - old).max(axis=1) > tol).sum()], float) if len(old) else np.zeros(1)

        still = added(both, {"g": k, "n": k}, moved)[0]
        rows = both.select("row", *[F.col(f"n{i}").alias(f"g{i}") for i in ks])
        if not still:
            break
    return mapped(rows, ["row"], {"g": k}, lambda t: {"share": t["g"] / t["g"].sum(axis=1, keepdims=True)}, {"share": k}).withColumnRenamed("row", row)
