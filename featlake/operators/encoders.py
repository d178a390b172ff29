"""Target, count and frequency encoders, and imputation from groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.operators.joins import enrich
from featlake.operators.quantiles import column_medians, grouped_median, grouped_quantile, value_counts_by
from featlake.session import settle


def _stat(df: DataFrame, keys: list[str], target: str, stat: str, out: str) -> DataFrame:
    if stat == "median":
        return grouped_median(df, keys, target, out)
    fn = {"mean": F.avg, "std": F.stddev_samp}[stat]
    return df.dropna(subset=keys).groupBy(*keys).agg(fn(target).alias(out))


def target_encode(df: DataFrame, key: str, target: str, stat: str = "median", train: DataFrame | None = None,
                  out: str = "encoded") -> DataFrame:
    """Statistic of the target per key, learned on ``train``; keys unseen there give null."""
    return enrich(df, _stat(df if train is None else train, [key], target, stat, out), key)


def _other_folds(df: DataFrame, key: str, target: str, fold: str) -> DataFrame:
    """Count, mean and sum of squared distances from it (``n``, ``m``, ``d``) of the target per (key, fold) over the other folds of the key.

    Every fold that occurs with a key has a row, also one whose targets are all missing. Folds are merged by their means
    and centred sums, which keeps the digits of large values. A key has one small array with an entry per fold.
    """
    t = F.col(target).cast("double")
    part = df.where(F.col(key).isNotNull()).groupBy(key, fold).agg(
        F.count(t).alias("n"), F.coalesce(F.avg(t), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop(t) * F.count(t), F.lit(0.0)).alias("d"))
    every = part.groupBy(key).agg(F.collect_list(F.struct(fold, "n", "m", "d")).alias("_folds"))

    def merge(acc, f):
        n, gap = acc["n"] + f["n"], f["m"] - acc["m"]
        share = F.coalesce(F.try_divide(f["n"].cast("double"), n), F.lit(0.0))
        return F.struct(n.alias("n"), (acc["m"] + gap * share).alias("m"), (acc["d"] + f["d"] + gap * gap * acc["n"] * share).alias("d"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("d"))
    spread = every.select(key, "_folds", F.explode(F.transform("_folds", lambda f: f[fold])).alias(fold))
    others = F.filter("_folds", lambda f: ~f[fold].eqNullSafe(F.col(fold)))
    return spread.select(key, fold, F.aggregate(others, zero, merge).alias("_o")).select(key, fold, "_o.n", "_o.m", "_o.d")


def oof_table(df: DataFrame, key: str, target: str, fold: str, stat: str, out: str) -> DataFrame:
    """(key, fold, statistic over all other folds)."""
    if stat == "median":
        return _oof_median(df, key, target, fold, out)
    o = _other_folds(df, key, target, fold)
    if stat == "mean":
        return o.select(key, fold, F.when(F.col("n") > 0, F.col("m")).alias(out))
    return o.select(key, fold, F.when(F.col("n") > 1, F.sqrt(F.col("d") / (F.col("n") - 1))).alias(out))


def _oof_median(df: DataFrame, key: str, target: str, fold: str, out: str) -> DataFrame:
    """Each distinct value keeps its count per fold; a fold sees the total less its own count."""
    counts = value_counts_by(df, [key, fold], target)
    per_value = settle(counts.groupBy(key, target).agg(
        F.sum("n").alias("_all"), F.map_from_entries(F.collect_list(F.struct(fold, "n"))).alias("_own")))
    # every fold of the table, so that one without a known target of a key still sees the key's other folds
    ids = df.where(F.col(fold).isNotNull()).agg(F.sort_array(F.collect_set(fold))).scalar()
    spread = (per_value.withColumn(fold, F.explode(ids))
              .withColumn("n", F.col("_all") - F.coalesce(F.try_element_at("_own", F.col(fold)), F.lit(0)))
              .where("n > 0"))
    return grouped_quantile(spread, [key, fold], target, 0.5, out, weight="n")


def target_encode_oof(df: DataFrame, key: str, target: str, fold: str, stat: str = "mean", out: str = "encoded",
                      test: DataFrame | None = None) -> DataFrame:
    """Leak-free encoding: a row sees only rows of other folds; ``test`` rows see all of them."""
    enc = enrich(df, oof_table(df, key, target, fold, stat, out), [key, fold])
    if test is None:
        return enc
    return enc.unionByName(enrich(test, _stat(df, [key], target, stat, out), key), allowMissingColumns=True)


def target_encode_smooth(df: DataFrame, key: str, target: str, smoothing: float = 1.0, min_leaf: float = 1.0,
                         train: DataFrame | None = None, noise: float = 0.0, seed: int = 0, out: str = "encoded") -> DataFrame:
    """Mean target drawn towards the prior for rare keys; unseen keys get the prior.

    ``noise`` multiplies the code by 1 + noise * a seeded normal number.
    """
    base = df if train is None else train
    prior = base.agg(F.avg(target)).scalar()
    s = 1 / (1 + F.exp(-(F.col("_n") - min_leaf) / smoothing))
    dim = (base.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(target).alias("_m"), F.count(target).alias("_n"))
           .select(key, (prior * (1 - s) + F.col("_m") * s).alias(out)))
    enc = enrich(df, dim, key).withColumn(out, F.coalesce(F.col(out), prior))
    return enc.withColumn(out, F.col(out) * (1 + noise * F.randn(seed))) if noise else enc


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key_name, key, n) for every listed column, in one pass."""
    cells = [F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key")) for k in keys]
    return (df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where(F.col("key").isNotNull())
            .groupBy("key_name", "key").agg(F.count(F.lit(1)).alias("n")))


def count_encode(df: DataFrame, keys: list[str], train: DataFrame | None = None, prefix: str = "count_") -> DataFrame:
    """Frequency of each key value among the training rows."""
    counts = settle(key_counts(df if train is None else train, keys))
    out = df
    for k in keys:  # a dictionary of its own for each key, so that its own size decides how it is joined
        dim = settle(counts.where(F.col("key_name") == k).select(F.col("key").alias("_k"), F.col("n").alias(f"{prefix}{k}")))
        out = out.withColumn("_k", F.col(k).cast("string")).join(dim, "_k", "left").drop("_k")
    return out


def per_capita(df: DataFrame, key: str, population: str, out: str, per: float = 1e6) -> DataFrame:
    """Rows of the key per ``per`` inhabitants."""
    enc = count_encode(df, [key], prefix="_n_")
    return enc.withColumn(out, F.try_divide(F.col(f"_n_{key}"), F.col(population)) * per).drop(f"_n_{key}")


def group_mode(df: DataFrame, by: str, col: str, out: str = "mode") -> DataFrame:
    """Most frequent value per group, the smallest on a tie; values are counted before they meet."""
    counts = df.where(F.col(by).isNotNull() & F.col(col).isNotNull()).groupBy(by, col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(by).agg(F.min_by(F.col(col), F.struct(-F.col("_n"), F.col(col))).alias(out))


def impute_group(df: DataFrame, col: str, by: str, how: str = "median", train: DataFrame | None = None) -> DataFrame:
    """Fill missing values with the group's mode or median; an all-null group stays null."""
    base = df if train is None else train
    dim = group_mode(base, by, col, "_fill") if how == "mode" else grouped_median(base, [by], col, "_fill")
    return enrich(df, dim, by).withColumn(col, F.coalesce(F.col(col), F.col("_fill"))).drop("_fill")


def impute_global(df: DataFrame, cols: list[str], how: str = "median", train: DataFrame | None = None) -> DataFrame:
    """Fill missing values with the column's median or mean over the training rows."""
    base = df if train is None else train
    row = column_medians(base, cols) if how == "median" else base.agg(*[F.avg(c).alias(c) for c in cols])
    stats: Column = row.select(F.struct(*cols)).scalar()
    return (df.withColumn("_s", stats)
            .withColumns({c: F.coalesce(F.col(c), F.col(f"_s.{c}")) for c in cols}).drop("_s"))
