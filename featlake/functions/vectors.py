"""Array columns as vectors and as token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from featlake.functions.binding import bind


def vector_moments(col: Column, prefix: str = "v") -> list[Column]:
    """Mean, max, min, deviation, sum, skewness, excess kurtosis (population moments) and entropy.

    Entropy is that of the values scaled to sum 1; null when a value is negative.
    """
    def sum_of(x, f):
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))

    def power(mean, p):
        return lambda v: F.pow(v - mean, F.lit(p))

    def share(v, total):
        return F.coalesce(F.try_divide(v, total), F.lit(0.0))

    def moments(t):
        x, total, n = t["x"], t["total"], F.size(t["x"])
        return bind(F.try_divide(total, n), lambda mean: F.struct(
            x.alias("x"), total.alias("total"), mean.alias("mean"),
            *[F.try_divide(sum_of(x, power(mean, p)), n).alias(f"m{p}") for p in (2, 3, 4)],
            sum_of(x, lambda v: F.when(v > 0, share(v, total) * F.log(share(v, total))).otherwise(0.0)).alias("plogp")))

    doubles = F.transform(col, lambda v: v.cast("double"))
    summed = bind(doubles, lambda x: F.struct(x.alias("x"), sum_of(x, lambda v: v).alias("total")))
    s = bind(summed, moments)
    return [s["mean"].alias(f"{prefix}_mean"), F.array_max(s["x"]).alias(f"{prefix}_max"), F.array_min(s["x"]).alias(f"{prefix}_min"),
            F.sqrt(s["m2"]).alias(f"{prefix}_std"), s["total"].alias(f"{prefix}_sum"),
            F.try_divide(s["m3"], F.pow(s["m2"], F.lit(1.5))).alias(f"{prefix}_skew"),
            (F.try_divide(s["m4"], s["m2"] * s["m2"]) - 3).alias(f"{prefix}_kurtosis"),
            F.when((F.array_min(s["x"]) >= 0) & (s["total"] > 0), -s["plogp"] + 0.0).alias(f"{prefix}_entropy")]


def pad_sequence(col: Column, n: int, side: str = "left", pad: int = 0) -> Column:
    """Exactly ``n`` ids: long sequences keep their last ``n``, short ones are padded on ``side``."""
    kept = F.when(F.size(col) > n, F.slice(col, -n, n)).otherwise(col)
    fill = F.array_repeat(F.lit(pad).cast("int"), F.greatest(F.lit(n) - F.size(col), F.lit(0)))
    return F.concat(fill, kept) if side == "left" else F.concat(kept, fill)


def vector_to_columns(col: Column, n: int, prefix: str = "v_") -> list[Column]:
    return [col.getItem(i).alias(f"{prefix}{i}") for i in range(n)]


def columns_to_vector(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("float") for c in cols])


def one_hot(col: Column, values: list, prefix: str) -> list[Column]:
    """One 0/1 column per listed value; a null or unlisted value gives only zeros."""
    return [F.coalesce((col == v).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in values]
