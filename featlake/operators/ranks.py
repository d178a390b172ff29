"""Ranks, label codes, first rows per key, rank-based scaling and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.operators.ordering import global_index
from featlake.operators.quantiles import prefix_sums, value_counts_by
from featlake.session import settle


def rank_avg(df: DataFrame, value: str, by: list[str], out: str = "rank", descending: bool = True,
             fill: float | None = -1.0) -> DataFrame:
    """Rank of ``value`` within its group; equal values share their mean rank.

    A missing value is ranked as ``fill``. Rows with a null group get a null rank.
    """
    v = F.coalesce(F.col(value).cast("double"), F.lit(fill)) if fill is not None else F.col(value).cast("double")
    rows = df.withColumn("_v", v)
    counts = value_counts_by(rows, by, "_v")
    ranks = prefix_sums(counts, by, "_v", descending=descending).select(
        *by, "_v", (F.col("before") + (F.col("n") + 1) / 2.0).alias(out))
    return rows.join(settle(ranks), [*by, "_v"], "left").drop("_v")


def label_codes(df: DataFrame, cols: list[str], null_token: str = "nan") -> DataFrame:
    """(column, value, code) for every distinct value, coded 0.. in text order per column."""
    cells = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(null_token)).alias("value"))
             for c in cols]
    distinct = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").distinct()
    pos = settle(global_index(distinct, ["column", "value"], "_i"))
    first = pos.groupBy("column").agg(F.min("_i").alias("_first"))
    return pos.join(first, "column").select("column", "value", (F.col("_i") - F.col("_first")).cast("int").alias("code"))


def label_encode(df: DataFrame, cols: list[str], null_token: str = "nan") -> DataFrame:
    """Replace each column by its label code; one dictionary serves train and test rows alike."""
    codes = settle(label_codes(df, cols, null_token))
    out = df
    for c in cols:
        dim = settle(codes.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code")))
        out = (out.withColumn("_v", F.coalesce(F.col(c).cast("string"), F.lit(null_token)))
               .join(dim, "_v", "left").drop("_v", c).withColumnRenamed("_code", c))
    return out.select(*df.columns)


def dedupe_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key in an explicit order, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*key).agg(first).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


# Coefficients of the percentage points of the normal distribution, central and
# intermediate range (Wichura, Applied Statistics 37, 1988, algorithm AS 241), highest power first.
AS241_CENTRE_NUM = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
                    13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080]
AS241_CENTRE_DEN = [5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867,
                    5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0]
AS241_TAIL_NUM = [7.7454501427834140764e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258,
                  3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734]
AS241_TAIL_DEN = [1.05075007164441684324e-9, 5.475938084995344946e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
                  6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0]


def erfinv_sql(x: str) -> str:
    """SQL text of the inverse error function for |x| < 1 - 1e-10, to double precision.

    Text, because Spark and the checking engine then evaluate the same formula.
    """
    def num(v):
        return f"{v:.17e}"  # the exponent makes the literal a double everywhere

    def poly(coefs, r):
        out = num(coefs[0])
        for c in coefs[1:]:
            out = f"({out} * {r} + {num(c)})"
        return out

    half = f"({x} / {num(2)})"
    r = f"({num(0.180625)} - {half} * {half})"
    tail = f"(sqrt(-ln({num(0.5)} - abs({half}))) - {num(1.6)})"
    centre = f"{half} * {poly(AS241_CENTRE_NUM, r)} / {poly(AS241_CENTRE_DEN, r)}"
    far = f"sign({x}) * {poly(AS241_TAIL_NUM, tail)} / {poly(AS241_TAIL_DEN, tail)}"
    return f"((CASE WHEN abs({x}) <= {num(0.85)} THEN {centre} ELSE {far} END) / sqrt({num(2)}))"


# Fixed value: distance kept from the ends of (-1, 1).
GAUSS_EPSILON = 0.001


def gauss_rank(df: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """Rank-based scaling to a normal shape; equal values are ordered by key."""
    idx = global_index(df.select(key, value).where(F.col(value).isNotNull()), [value, key], "_i")
    n = df.where(F.col(value).isNotNull()).agg(F.count(F.lit(1))).scalar()
    upper = 1 - GAUSS_EPSILON
    x = F.when(n > 1, F.col("_i") / ((n - 1) / (2 * upper)) - upper).otherwise(F.lit(0.0))
    return (idx.withColumn("_x", x).withColumn(out, F.expr(erfinv_sql("_x"))).select(key, value, out))


def build_vocab(df: DataFrame, token: str, n: int | None = None) -> DataFrame:
    """Tokens numbered from 1 by falling frequency, then by text; the first ``n`` of them."""
    counts = df.where(F.col(token).isNotNull()).groupBy(token).agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc(token)]
    if n is not None:
        counts = counts.orderBy(*order).limit(n)
    return global_index(counts, order, "_i").withColumn("id", F.col("_i") + 1).drop("_i")
