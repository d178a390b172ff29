"""Keyed profiles: counts, distinct users, exact medians, spreads and active spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.operators.quantiles import grouped_median, grouped_quantile
from featlake.session import settle, spread

TASK_ROWS = 100_000


def with_median(base: DataFrame, df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Add the exact per-key median of ``df[value]`` to a table that has one row per key."""
    return base.join(grouped_median(df, keys, value, out), keys, "left")


def _spread(value: str, stats: list[str]) -> list:
    fn = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
    return [fn[s](value).alias(f"{value}_{s}") for s in stats]


def category_profile(df: DataFrame, key: str, user: str, value: str, date: str, null_token=None) -> DataFrame:
    """Per category: rows, distinct users, value median/std/max/min, span in days, span per row.

    Null keys are left out, or counted under ``null_token``.
    """
    if null_token is not None:
        df = df.fillna({key: null_token})
    df = df.where(F.col(key).isNotNull())
    base = (df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("count"), F.countDistinct(user).alias("unique_user_count"),
                 *_spread(value, ["std", "max", "min"]),
                 F.datediff(F.max(date), F.min(date)).alias("diff"))
            .withColumn("average_period", F.col("diff") / F.col("count")))
    return with_median(base, df, [key], value, f"{value}_median")


def category_weekday_profile(df: DataFrame, key: str, user: str, value: str, date: str) -> DataFrame:
    """The category profile per weekday, without the span."""
    df = df.where(F.col(key).isNotNull()).withColumn("weekday", F.weekday(date))
    keys = [key, "weekday"]
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.countDistinct(user).alias("unique_user_count"),
                                 *_spread(value, ["std", "max", "min"]))
    return with_median(base, df, keys, value, f"{value}_median")


def value_profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key frequency with value median/mean/std/max/min; keys without any value keep their count."""
    df = df.where(F.col(key).isNotNull())
    base = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"), *_spread(value, ["mean", "std", "max", "min"]))
    return with_median(base, df, [key], value, f"{value}_median")


def user_value_stats(df: DataFrame, user: str, value: str) -> DataFrame:
    """Value statistics per user over its non-null values; every user is kept."""
    df = df.where(F.col(user).isNotNull())
    base = df.groupBy(user).agg(*_spread(value, ["mean", "std", "min", "max"]))
    return with_median(base, df, [user], value, f"{value}_median")


def user_activity(df: DataFrame, user: str, date: str) -> DataFrame:
    """Rows, active span in days and span per row of each user."""
    return (df.where(F.col(user).isNotNull()).groupBy(user)
            .agg(F.count(F.lit(1)).alias("user_count"), F.datediff(F.max(date), F.min(date)).alias("user_period"))
            .withColumn("user_average_period", F.col("user_period") / F.col("user_count")))


def user_weekday_profile(df: DataFrame, user: str, date: str, value: str) -> DataFrame:
    """Rows and value median/std/max/min per user and weekday."""
    df = df.where(F.col(user).isNotNull()).withColumn("weekday", F.weekday(date))
    keys = [user, "weekday"]
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), *_spread(value, ["std", "max", "min"]))
    return with_median(base, df, keys, value, f"{value}_median")


def user_diversity(df: DataFrame, user: str, cols: list[str], token: str = "_NAN_") -> DataFrame:
    """Distinct values of each column per user; null counts as one value.

    Every row becomes one for each column, so a task gets ``TASK_ROWS`` rows; a user's values are told apart where they were cut.
    """
    rows = spread(df.where(F.col(user).isNotNull()), [user], TASK_ROWS)
    values = [F.struct(F.lit(i).alias("_c"), F.coalesce(F.col(c).cast("string"), F.lit(token)).alias("_v")) for i, c in enumerate(cols)]
    distinct = rows.select(user, F.explode(F.array(*values)).alias("_s")).select(user, "_s._c", "_s._v").distinct()
    return distinct.groupBy(user).agg(*[F.count(F.when(F.col("_c") == i, 1)).alias(f"{c}_nunique") for i, c in enumerate(cols)])


def user_extremes(df: DataFrame, user: str, seq: str) -> DataFrame:
    return df.where(F.col(user).isNotNull()).groupBy(user).agg(
        F.max(seq).alias(f"{seq}_max"), F.min(seq).alias(f"{seq}_min"))


def item_periods(periods: DataFrame, item: str = "item_id") -> DataFrame:
    """Days on shelf and number of periods per item."""
    days = F.datediff("date_to", "date_from")
    return periods.where(F.col(item).isNotNull()).groupBy(item).agg(
        F.sum(days).alias("days_up_sum"), F.count(days).alias("times_put_up"), F.max(days).alias("days_up_max"),
        F.min(days).alias("days_up_min"), F.avg(days).alias("days_up_mean"))


def _per_user(per_item: DataFrame, items: DataFrame, user: str, item: str) -> DataFrame:
    """Attach the user of each item; every item counts once, with the least user if it occurs with several."""
    owners = items.where(F.col(item).isNotNull()).groupBy(item).agg(F.min(user).alias(user))
    return per_item.join(owners, item, "inner").where(F.col(user).isNotNull())


def user_periods(periods: DataFrame, items: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Mean, max and min of the item period statistics per user, and the user's number of items."""
    per_user = _per_user(item_periods(periods, item), items, user, item).groupBy(user).agg(
        F.avg("days_up_sum").alias("avg_days_up_user"), F.avg("times_put_up").alias("avg_times_up_user"),
        F.max("days_up_sum").alias("max_days_up_user"), F.min("days_up_sum").alias("min_days_up_user"),
        F.max("times_put_up").alias("max_times_up_user"), F.min("times_put_up").alias("min_times_up_user"))
    n_items = (items.where(F.col(user).isNotNull()).groupBy(user)
               .agg(F.countDistinct(item).alias("n_user_items")))
    return per_user.join(n_items, user, "full_outer")


def user_wait(periods: DataFrame, items: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Waiting days between activation and start, summed per item and averaged per user."""
    wait = F.datediff("date_from", "activation_date")
    per_item = periods.where(F.col(item).isNotNull()).groupBy(item).agg(
        F.sum(wait).alias("days_wait_sum"), F.count(wait).alias("times_put_wait"))
    return _per_user(per_item, items, user, item).groupBy(user).agg(
        F.avg("days_wait_sum").alias("avg_days_wait_user"), F.avg("times_put_wait").alias("avg_times_wait_user"))


def group_days_up(periods: DataFrame, items: DataFrame, by: str, item: str = "item_id") -> DataFrame:
    """Spread of the mean days on shelf of the items in each group; items without periods stay null.

    An item that occurs with several groups belongs to the least one.
    """
    per_item = periods.groupBy(item).agg(F.avg(F.datediff("date_to", "date_from")).alias("days_up"))
    joined = items.groupBy(item).agg(F.min(by).alias(by)).join(per_item, item, "left")
    return joined.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.avg("days_up").alias("days_up_mean"), F.stddev_samp("days_up").alias("days_up_std"),
        F.max("days_up").alias("days_up_max"), F.min("days_up").alias("days_up_min"))


def weekday_median(df: DataFrame, date: str, value: str) -> DataFrame:
    """Rows with their weekday and that weekday's median value."""
    out = df.withColumn("weekday", F.weekday(date))
    return out.join(settle(grouped_median(out, ["weekday"], value, f"weekday_{value}_median")), "weekday", "left")


def stat_grid(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Median of every value per every single key, long form, from one pass over ``df``.

    Result: key_name, key (as text), value_name, n, median.
    """
    cells = [F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key"),
                      F.lit(v).alias("value_name"), F.col(v).cast("double").alias("value"))
             for k in keys for v in values]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return grouped_quantile(long, ["key_name", "key", "value_name"], "value", count="n")


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts as (a, b, n) rows; the form to use when ``b`` has many values."""
    return df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """Contingency table with one column per listed value of ``b``; absent pairs count 0."""
    return df.dropna(subset=[a, b]).groupBy(a).pivot(b, values).count().fillna(0)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Rows per equal-width bin of [lo, hi], empty bins with 0; the last bin includes ``hi``, values outside are left out."""
    width = (hi - lo) / bins
    bin_no = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int")
    found = df.where(F.col(col).between(lo, hi)).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def row_histogram(df: DataFrame, key: str, values: str, lo: float, hi: float, bins: int, out: str = "histogram") -> DataFrame:
    """Per row, how many elements of an array column lie in each equal-width bin of [lo, hi], as an array of ``bins`` numbers.

    The array is sorted into bins inside its own row; null arrays and arrays without values in range give zeros.
    """
    width = (hi - lo) / bins
    inside = F.filter(F.coalesce(F.col(values), F.array()), lambda v: v.between(lo, hi))
    places = F.transform(inside, lambda v: F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int"))
    cells = (df.select(key, values, F.monotonically_increasing_id().alias("_row")).select(key, "_row", F.explode_outer(places).alias("_bin"))
             .groupBy(key, "_row", "_bin").agg(F.count("_bin").alias("_n")))
    counts = cells.groupBy(key, "_row").agg(F.map_from_entries(F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct("_bin", "_n")))).alias("_m"))
    return counts.select(key, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0))).alias(out))


def importance_share(df: DataFrame, k: int, feature: str = "feature", gain: str = "gain") -> DataFrame:
    """Share of each feature in the total gain, in percent; the top ``k`` (ties by name)."""
    total = df.agg(F.sum(gain)).scalar()
    return (df.select(feature, gain, (F.lit(100.0) * F.col(gain) / total).alias("share"))
            .orderBy(F.desc("share"), feature).limit(k))


# Weekday numbers follow Monday = 0.
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def weekday_on_shelf(periods: DataFrame, date_from: str = "date_from", date_to: str = "date_to") -> DataFrame:
    """One 0/1 flag per weekday that lies in [date_from, date_to]; no date is expanded.

    A weekday is covered when the first such day after the start is not past the end.
    """
    span = F.datediff(date_to, date_from)
    return periods.select("*", *[
        F.when(span < 0, 0).when(F.pmod(F.lit(d) - F.weekday(date_from), F.lit(7)) <= span, 1).otherwise(0)
        .alias(f"on_{n}") for d, n in enumerate(WEEKDAYS)])


def weekday_code_sums(flagged: DataFrame, code: str) -> DataFrame:
    """Sum of a code over the rows with each weekday flag 0 or 1 (weekday, flag, total)."""
    sums = flagged.agg(*[F.sum(F.when(F.col(f"on_{n}") == f, F.col(code))).alias(f"{n}_{f}")
                         for n in WEEKDAYS for f in (0, 1)])
    cells = [F.struct(F.lit(n).alias("weekday"), F.lit(f).alias("flag"), F.col(f"{n}_{f}").alias("total"))
             for n in WEEKDAYS for f in (0, 1)]
    return sums.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
