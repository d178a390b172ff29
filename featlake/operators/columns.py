"""Column selection, row filters, null handling and standardising."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def prune_listed(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the columns named in a list; names that are not there are ignored."""
    return df.select(*[c for c in df.columns if c not in set(names)])


def zero_gain(importance: DataFrame, feature: str = "feature", gain: str = "gain", limit: float = 1.0) -> DataFrame:
    """Features whose gain is below ``limit``."""
    return importance.where(F.col(gain) < limit).select(feature)


def importance_from_json(df: DataFrame, col: str) -> DataFrame:
    """Long (feature, gain) table from a JSON map of gains."""
    return df.select(F.explode(F.from_json(col, "map<string,double>")).alias("feature", "gain"))


def prune_pattern(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Drop columns whose name contains a match of any pattern."""
    return df.select(*[c for c in df.columns if not any(re.search(p, c) for p in patterns)])


def column_difference(df: DataFrame, other: list[str]) -> list[str]:
    """Column names of ``df`` that are not in ``other``, in order."""
    return [c for c in df.columns if c not in set(other)]


def columns_with_null(df: DataFrame) -> list[str]:
    """Names of columns that hold a null or NaN, found in one aggregate."""
    miss = [F.max(_missing(c, t).cast("int")).alias(c) for c, t in df.dtypes]
    row = df.agg(*miss).first()
    return [c for c in df.columns if row[c]]


def _missing(name: str, dtype: str) -> Column:
    c = F.col(name)
    return c.isNull() | F.isnan(c) if dtype in ("double", "float") else c.isNull()


def drop_null_columns(df: DataFrame) -> DataFrame:
    return df.drop(*columns_with_null(df))


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.dropna(subset=subset)


def split_known(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a known value and rows without."""
    return df.where(F.col(col).isNotNull()), df.where(F.col(col).isNull())


def split_by_date(df: DataFrame, col: str, last_train: str, first_valid: str) -> tuple[DataFrame, DataFrame]:
    """Rows up to one date and rows from another date on."""
    return (df.where(F.col(col) <= F.to_date(F.lit(last_train))),
            df.where(F.col(col) >= F.to_date(F.lit(first_valid))))


def mark_split(train: DataFrame, test: DataFrame, col: str = "split") -> DataFrame:
    """Union of train and test rows with a marker column; columns absent on one side are null."""
    return (train.withColumn(col, F.lit("train"))
            .unionByName(test.withColumn(col, F.lit("test")), allowMissingColumns=True))


def take_split(df: DataFrame, name: str, col: str = "split") -> DataFrame:
    return df.where(F.col(col) == name).drop(col)


def fill_const(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


def coalesce_cols(*cols: str) -> Column:
    return F.coalesce(*cols)


def null_flags(df: DataFrame, cols: list[str], total: str = "n_null") -> DataFrame:
    """0/1 null flag per column and the number of nulls of the row."""
    types = dict(df.dtypes)
    flags = [_missing(c, types[c]).cast("int") for c in cols]
    return df.select("*", *[f.alias(f"{c}_null") for c, f in zip(cols, flags)], sum(flags, F.lit(0)).alias(total))


def downcast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Narrow the named columns; a value that does not fit becomes null instead of wrapping."""
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


# Substrings whose presence in a description is flagged.
DESCRIPTION_KEYWORDS = {
    "is_in_desc_хорошо": "хорошо", "is_in_desc_Плохо": "Плохо", "is_in_desc_новый": "новый", "is_in_desc_старый": "старый",
    "is_in_desc_используемый": "используемый", "is_in_desc_есплатная_доставка": "есплатная доставка",
    "is_in_desc_есплатный_возврат": "есплатный возврат", "is_in_desc_идеально": "идеально",
    "is_in_desc_подержанный": "подержанный", "is_in_desc_пСниженные_цены": "Сниженные цены",
}


def keyword_flags(df: DataFrame, col: str, words: dict[str, str] = DESCRIPTION_KEYWORDS) -> DataFrame:
    """0/1 flag per keyword (name -> substring); case counts, null text counts as empty."""
    text = F.coalesce(F.col(col), F.lit(""))
    return df.select("*", *[F.contains(text, F.lit(w)).cast("int").alias(n) for n, w in words.items()])


def fill_max_plus_one(df: DataFrame, col: str) -> DataFrame:
    """Give missing values a code of their own: the column's maximum plus one."""
    top = df.agg(F.max(col) + 1).scalar()
    return df.withColumn(col, F.coalesce(F.col(col), top))


def stats_row(df: DataFrame, cols: list[str]) -> Column:
    """Mean and population deviation of every column, as one scalar-subquery struct."""
    return df.agg(F.struct(*[F.avg(c).alias(f"{c}_mean") for c in cols],
                           *[F.stddev_pop(c).alias(f"{c}_std") for c in cols]).alias("s")).scalar()


def standardise(df: DataFrame, cols: list[str], mask_null: bool = False, train: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column gives 0.

    Statistics come from ``train`` when given. ``mask_null`` turns missing values into 0.
    """
    stats = stats_row(df if train is None else train, cols)
    out = df.withColumn("_stats", stats)
    z = {}
    for c in cols:
        mean, std = F.col(f"_stats.{c}_mean"), F.col(f"_stats.{c}_std")
        v = F.when(std == 0, F.col(c) - mean).otherwise((F.col(c) - mean) / std)
        z[c] = F.coalesce(v, F.lit(0.0)) if mask_null else v
    return out.withColumns(z).drop("_stats")


def scale_target(df: DataFrame, col: str, out: str) -> DataFrame:
    """Standardised log1p of a target."""
    return standardise(df.withColumn(out, F.log1p(col)), [out])


def unscale(df: DataFrame, col: str, reference: DataFrame, target: str, out: str) -> DataFrame:
    """Bring standardised log1p predictions back to the scale of ``reference[target]``."""
    stats = stats_row(reference.select(F.log1p(target).alias("t")), ["t"])
    return (df.withColumn("_stats", stats)
            .withColumn(out, F.expm1(F.col(col) * F.col("_stats.t_std") + F.col("_stats.t_mean"))).drop("_stats"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Row union by column name; columns absent from one side are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Set union of values."""
    return union_all(*frames).distinct()
