"""Encoder and imputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.operators import encoders as E
from featlake.operators.joins import lookup
from featlake.plans.registry import query, r6, round_doubles
from featlake.sources import views as V

_TRAIN = "train AS (SELECT * FROM ads WHERE split = 'train')"


def _learned(name, key, stat, sql_stat):
    @query(name, f"""
WITH {V.ADS_SQL}, {_TRAIN}, m AS (SELECT {key} AS k, {sql_stat}(target) AS v FROM train WHERE {key} IS NOT NULL GROUP BY 1)
SELECT item_id, round(v, 6) AS encoded FROM ads LEFT JOIN m ON {key} = k""")
    def run(spark, sf):
        a = V.ads(spark, sf, "item_id", key, "target", "split")
        enc = E.target_encode(a.select("item_id", key), key, "target", stat, train=a.where("split = 'train'"))
        return enc.select("item_id", r6("encoded").alias("encoded"))
    return run


_learned("d15_target_median", "param_1", "median", "median")
_learned("d15_target_median_user", "user_id", "median", "median")
_learned("d16_target_mean", "image_top_1", "mean", "avg")
_learned("d16_target_std", "user_id", "std", "stddev_samp")


def _oof(name, key, stat, sql_stat):
    @query(name, f"""
WITH {V.ADS_SQL}, {_TRAIN}, f AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold),
m AS (SELECT {key} AS k, f.fold, {sql_stat}(target) AS v FROM train JOIN f ON train.fold <> f.fold WHERE {key} IS NOT NULL GROUP BY 1, 2),
t AS (SELECT {key} AS k, {sql_stat}(target) AS v FROM train WHERE {key} IS NOT NULL GROUP BY 1)
SELECT item_id, round(v, 6) AS encoded FROM train LEFT JOIN m ON train.{key} = m.k AND train.fold = m.fold
UNION ALL SELECT item_id, round(v, 6) FROM ads LEFT JOIN t ON {key} = k WHERE split = 'test'""")
    def run(spark, sf):
        a = V.ads(spark, sf, "item_id", key, "target", "split", "fold")
        enc = E.target_encode_oof(a.where("split = 'train'").drop("split"), key, "target", "fold", stat,
                                  test=a.where("split = 'test'").select("item_id", key))
        return enc.select("item_id", r6("encoded").alias("encoded"))
    return run


_oof("d17_oof_mean", "user_id", "mean", "avg")
_oof("d17_oof_std", "category_name", "std", "stddev_samp")
_oof("d17_oof_median", "param_2", "median", "median")
_oof("d17_oof_median_user", "user_id", "median", "median")
_oof("j10_mean_oof", "param_1", "mean", "avg")


def _oof_odd(name, key, stat, sql_stat, change_sql, change):
    """Out-of-fold encoding of a changed target: missing for some rows, or far from zero."""
    @query(name, f"""
WITH {V.ADS_SQL}, {_TRAIN}, c AS (SELECT item_id, {key} AS k, fold, {change_sql} AS y FROM train), f AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold),
m AS (SELECT k, f.fold, {sql_stat}(y) AS v FROM c JOIN f ON c.fold <> f.fold WHERE k IS NOT NULL GROUP BY 1, 2)
SELECT item_id, round(v, 6) AS encoded FROM c LEFT JOIN m ON c.k = m.k AND c.fold = m.fold""")
    def run(spark, sf):
        a = V.ads(spark, sf, "item_id", key, "target", "split", "fold", "item_seq_number", "price").where("split = 'train'")
        enc = E.target_encode_oof(a.withColumn("y", F.expr(change)), key, "y", "fold", stat)
        return enc.select("item_id", r6("encoded").alias("encoded"))
    return run


_oof_odd("d17_oof_mean_null_target", "user_id", "mean", "avg", "CASE WHEN item_seq_number % 3 = 0 THEN NULL ELSE target END",
         "CASE WHEN item_seq_number % 3 = 0 THEN NULL ELSE target END")
_oof_odd("d17_oof_median_null_target", "user_id", "median", "median", "CASE WHEN item_seq_number % 3 = 0 THEN NULL ELSE target END",
         "CASE WHEN item_seq_number % 3 = 0 THEN NULL ELSE target END")
_oof_odd("d17_oof_std_offset", "category_name", "std", "stddev_samp", "1e8::DOUBLE + target", "1e8D + target")


@query("d18_target_smooth", f"""
WITH {V.ADS_SQL}, {_TRAIN}, p AS (SELECT avg(target) AS prior FROM train),
m AS (SELECT user_id AS k, avg(target) AS a, 1 / (1 + exp(-(count(*) - 20) / 10.0::DOUBLE)) AS s FROM train GROUP BY 1)
SELECT item_id, round(coalesce(prior * (1 - s) + a * s, prior), 6) AS encoded FROM ads CROSS JOIN p LEFT JOIN m ON user_id = k""")
def d18(spark, sf):
    a = V.ads(spark, sf, "item_id", "user_id", "target", "split")
    enc = E.target_encode_smooth(a.select("item_id", "user_id"), "user_id", "target", smoothing=10.0, min_leaf=20.0,
                                 train=a.where("split = 'train'"))
    return enc.select("item_id", r6("encoded").alias("encoded"))


_KEYS = ["city", "region", "weekday", "param_1", "param_2", "image_top_1", "user_type", "parent_category_name", "item_seq_number"]


@query("d19_count_encode", f"""
WITH {V.ADS_SQL}, a AS (SELECT *, isodow(activation_date) - 1 AS weekday FROM ads), {_TRAIN.replace('FROM ads', 'FROM a')}
SELECT item_id, """ + ", ".join(
    f"CASE WHEN {k} IS NOT NULL THEN c{i}.n END AS count_{k}" for i, k in enumerate(_KEYS)) + " FROM a " + " ".join(
    f"LEFT JOIN (SELECT {k} AS k, count(*) AS n FROM train GROUP BY 1) c{i} ON a.{k} = c{i}.k" for i, k in enumerate(_KEYS)))
def d19(spark, sf):
    a = V.ads(spark, sf, "item_id", "split", "activation_date", *[k for k in _KEYS if k != "weekday"]).withColumn(
        "weekday", F.weekday("activation_date"))
    return E.count_encode(a, _KEYS, train=a.where("split = 'train'")).select("item_id", *[f"count_{k}" for k in _KEYS])


@query("d20_per_capita", f"""
WITH {V.ADS_SQL}, {V.INCOMES_SQL}, c AS (SELECT town, count(*) AS n FROM ads GROUP BY 1)
SELECT item_id, round(n / income * 1000000, 6) AS per_million FROM ads LEFT JOIN incomes ON ads.town = incomes.town
LEFT JOIN c ON ads.town = c.town""")
def d20(spark, sf):
    a = lookup(V.ads(spark, sf, "item_id", "town"), V.incomes(spark, sf), "town")
    return E.per_capita(a, "town", "income", "per_million").select("item_id", r6("per_million").alias("per_million"))


@query("d21_impute_mode", f"""
WITH {V.ADS_SQL}, c AS (SELECT category_name AS g, image_top_1 AS v, count(*) AS n FROM ads WHERE image_top_1 IS NOT NULL GROUP BY 1, 2),
m AS (SELECT g, min(v) AS v FROM c WHERE n = (SELECT max(n) FROM c d WHERE d.g = c.g) GROUP BY 1)
SELECT item_id, coalesce(image_top_1, v) AS image_top_1 FROM ads LEFT JOIN m ON category_name = g""")
def d21(spark, sf):
    a = V.ads(spark, sf, "item_id", "category_name", "image_top_1")
    return E.impute_group(a, "image_top_1", "category_name", "mode").drop("category_name")


@query("d22_impute_group_median", f"""
WITH {V.ADS_SQL}, m AS (SELECT category_name AS g, median(price) AS v FROM ads GROUP BY 1)
SELECT item_id, round(coalesce(price, v), 6) AS price FROM ads LEFT JOIN m ON category_name = g""")
def d22(spark, sf):
    a = V.ads(spark, sf, "item_id", "category_name", "price")
    return round_doubles(E.impute_group(a, "price", "category_name", "median").drop("category_name"))


@query("d23_impute_global", f"""
WITH {V.ADS_SQL}, m AS (SELECT median(price) AS a, median(image_top_1) AS b FROM ads WHERE split = 'train')
SELECT item_id, round(coalesce(price, a), 6) AS price, round(coalesce(image_top_1, b), 6) AS image_top_1 FROM ads, m""")
def d23(spark, sf):
    a = V.ads(spark, sf, "item_id", "price", "image_top_1", "split")
    return round_doubles(E.impute_global(a, ["price", "image_top_1"], "median", a.where("split = 'train'")).drop("split"))


@query("d23_impute_global_mean", f"""
WITH {V.ADS_SQL} SELECT item_id, round(coalesce(price, (SELECT avg(price) FROM ads)), 6) AS price FROM ads""")
def d23_mean(spark, sf):
    return round_doubles(E.impute_global(V.ads(spark, sf, "item_id", "price"), ["price"], "mean"))
