"""Numeric column expressions; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(col: Column, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; null stays null and NaN stays NaN."""
    return F.when(F.isnan(col.cast("double")), col).when(col.isNotNull(), F.greatest(F.least(col, F.lit(hi)), F.lit(lo)))


def binarise(col: Column, op: str, threshold: float) -> Column:
    """1 where ``col op threshold`` holds, else 0; null stays null."""
    test = {"==": col == threshold, ">=": col >= threshold, ">": col > threshold,
            "<=": col <= threshold, "<": col < threshold}[op]
    return test.cast("int")


def presence_flag(col: Column) -> Column:
    return (col.isNotNull() & (F.length(col) > 0)).cast("int")


def ratio(a: Column, b: Column, fill: float | None = None) -> Column:
    """a / b; null where b is 0 or either side is null, or ``fill`` there."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if fill is None else F.coalesce(out, F.lit(fill))


def interact(*cols: Column) -> Column:
    return reduce(lambda a, b: a * b, cols)


def add_cols(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, cols)


def concat_key(cols: list[Column], sep: str = "_", token: str = "nan") -> Column:
    """Joined key of several columns; null parts become ``token``."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit(token)) for c in cols])


def replace_inf(col: Column, pos: float, neg: float) -> Column:
    inf = F.lit(float("inf"))
    return F.when(col == inf, F.lit(pos)).when(col == -inf, F.lit(neg)).otherwise(col)


def log_shift(col: Column, c: float = 0.001) -> Column:
    """ln(x + c); null where x + c is not positive."""
    return F.when(col + c > 0, F.log(col + c))


def exp_shift(col: Column, c: float = 0.0001) -> Column:
    """Inverse of :func:`log_shift`."""
    return F.exp(col) - c


def log2_int(col: Column) -> Column:
    """Whole part of log2(1 + x)."""
    return F.when(col > -1, F.log2(1 + col).cast("int"))


def log_bucket(log_col: Column, factor: float) -> Column:
    """Half-even rounding of a logged value times a factor."""
    return F.bround(log_col * factor, 0).cast("int")


def round_bucket(col: Column, step: float) -> Column:
    return F.bround(col / step, 0).cast("int")


def length_code(length: Column, factor: float, plus_one: bool = False) -> Column:
    """Whole part of ln(length) * factor, or of ln(1 + length) * factor; an empty text gives null in the first form."""
    if plus_one:
        return (F.log1p(length) * factor).cast("int")
    return F.when(length > 0, (F.log(length) * factor).cast("int"))


# Upper price limits of clusters 1..6, then the scale used for cluster 7.
PRICE_CUTS = [500, 1000, 5000, 10000, 50000, 100000]
PRICE_TOP = 1000000
PRICE_BINS = 20


def price_cluster(col: Column) -> Column:
    """Cluster 1..7 by price limits; a missing price is cluster 8."""
    out = F.when(col.isNull() | F.isnan(col.cast("double")), 8)
    for i, cut in enumerate(PRICE_CUTS, 1):
        out = out.when(col < cut, i)
    return out.otherwise(7)


def price_parity(col: Column) -> Column:
    """+1 / -1 for odd / even twentieths of the cluster's upper limit, 0 for a missing price."""
    cluster = price_cluster(col)
    upper = F.element_at(F.array(*[F.lit(float(c)) for c in [*PRICE_CUTS, PRICE_TOP]]), F.least(cluster, F.lit(7)))
    bin_no = F.try_divide(col, upper / PRICE_BINS).try_cast("bigint") + 1
    return F.when(cluster == 8, 0).when(bin_no % 2 == 0, -1).otherwise(1)


def price_parity_onehot(col: Column, prefix: str = "price_bin_feature_") -> list[Column]:
    """Eight columns; the one of the row's cluster holds the parity, the others 0."""
    return [F.when(price_cluster(col) == c, price_parity(col)).otherwise(0).alias(f"{prefix}{c}") for c in range(1, 9)]


def stable_hash(col: Column) -> Column:
    """60-bit integer from md5: the same on every engine and in every run."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 15), 16, 10).cast("bigint")


def hash_bucket(col: Column, n: int, salt: str = "") -> Column:
    key = F.concat(F.lit(salt), col.cast("string")) if salt else col
    return F.pmod(stable_hash(key), F.lit(n)).cast("int")


def param_hash(price: Column, code: Column, width: float = 500.0) -> Column:
    """Price step times a category code."""
    return (price / width).try_cast("int") * code


def sigmoid(col: Column) -> Column:
    return 1 / (1 + F.exp(-col))
