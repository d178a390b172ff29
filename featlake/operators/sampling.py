"""Folds, hold-outs, reproducible samples and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.functions.numeric import hash_bucket, stable_hash


def assign_fold(df: DataFrame, key: str, k: int, seed: str = "", out: str = "fold") -> DataFrame:
    """Fold number from a hash of the key: no shuffle, the same in every run."""
    return df.withColumn(out, hash_bucket(F.col(key), k, seed))


def holdout(df: DataFrame, key: str, share: float, seed: str = "holdout") -> tuple[DataFrame, DataFrame]:
    """(kept, held out) split by a hash of the key."""
    out = hash_bucket(F.col(key), 10000, seed) < int(round(share * 10000))
    return df.where(~out), df.where(out)


def sample_n(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows that come first in a seeded random order."""
    return df.orderBy(stable_hash(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)
