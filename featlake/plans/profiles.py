"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.operators import profiles as P
from featlake.operators.joins import enrich
from featlake.plans.registry import query, round_doubles
from featlake.session import spread
from featlake.sources import views as V

_W = "isodow(activation_date) - 1"


@query("d1_category_profile", f"""
WITH {V.ADS_SQL}, p AS (
  SELECT category_name, count(*) AS n, count(DISTINCT user_id) AS users, median(price) AS md, stddev_samp(price) AS sd,
         max(price) AS mx, min(price) AS mn, date_diff('day', min(activation_date), max(activation_date)) AS span
  FROM ads GROUP BY 1)
SELECT a.item_id, a.category_name, p.n AS "count", p.users AS unique_user_count, round(md, 6) AS price_median,
       round(sd, 6) AS price_std, mx AS price_max, mn AS price_min, CAST(span AS INT) AS diff,
       round(span / p.n, 6) AS average_period
FROM ads a LEFT JOIN p ON a.category_name = p.category_name""")
def d1_category_profile(spark, sf):
    a = V.ads(spark, sf, "item_id", "category_name", "user_id", "price", "activation_date")
    prof = P.category_profile(a, "category_name", "user_id", "price", "activation_date")
    return round_doubles(enrich(a.select("item_id", "category_name"), prof, "category_name"))


@query("d1_category_profile_null_token", f"""
WITH {V.ADS_SQL}, p AS (
SELECT coalesce(param_1, 'NAN') AS param_1, count(*) AS "count", count(DISTINCT user_id) AS unique_user_count,
       round(median(price), 6) AS price_median, round(stddev_samp(price), 6) AS price_std, max(price) AS price_max,
       min(price) AS price_min, CAST(date_diff('day', min(activation_date), max(activation_date)) AS INT) AS diff,
       round(date_diff('day', min(activation_date), max(activation_date)) / count(*), 6) AS average_period
FROM ads GROUP BY 1)
SELECT item_id, p.* REPLACE (ads.param_1 AS param_1) FROM ads JOIN p ON coalesce(ads.param_1, 'NAN') = p.param_1""")
def d1_null_token(spark, sf):
    a = V.ads(spark, sf, "item_id", "param_1", "user_id", "price", "activation_date")
    prof = P.category_profile(a, "param_1", "user_id", "price", "activation_date", null_token="NAN")
    return round_doubles(enrich(a.select("item_id", "param_1"), prof, "param_1", null_token="NAN"))


_WEEKDAY_SQL = """
WITH {ads}
SELECT {key}, CAST(""" + _W + """ AS INT) AS weekday, count(*) AS "count", count(DISTINCT user_id) AS unique_user_count,
       round(median(price), 6) AS price_median, round(stddev_samp(price), 6) AS price_std, max(price) AS price_max,
       min(price) AS price_min
FROM ads {where} GROUP BY 1, 2"""


@query("d2_category_weekday_profile", _WEEKDAY_SQL.format(ads=V.ADS_SQL, key="category_name", where=""))
def d2(spark, sf):
    a = V.ads(spark, sf, "category_name", "user_id", "price", "activation_date")
    return round_doubles(P.category_weekday_profile(a, "category_name", "user_id", "price", "activation_date"))


@query("d3_image_code_profile", f"""
WITH {V.ADS_SQL}
SELECT image_top_1, count(*) AS "count", count(DISTINCT user_id) AS unique_user_count,
       round(median(price), 6) AS price_median, round(stddev_samp(price), 6) AS price_std, max(price) AS price_max,
       min(price) AS price_min, CAST(date_diff('day', min(activation_date), max(activation_date)) AS INT) AS diff,
       round(date_diff('day', min(activation_date), max(activation_date)) / count(*), 6) AS average_period
FROM ads WHERE image_top_1 IS NOT NULL GROUP BY 1""")
def d3(spark, sf):
    a = V.ads(spark, sf, "image_top_1", "user_id", "price", "activation_date")
    return round_doubles(P.category_profile(a, "image_top_1", "user_id", "price", "activation_date"))


@query("d3_image_code_weekday_profile",
       _WEEKDAY_SQL.format(ads=V.ADS_SQL, key="image_top_1", where="WHERE image_top_1 IS NOT NULL"))
def d3_weekday(spark, sf):
    a = V.ads(spark, sf, "image_top_1", "user_id", "price", "activation_date")
    return round_doubles(P.category_weekday_profile(a, "image_top_1", "user_id", "price", "activation_date"))


@query("d4_value_profile", f"""
WITH {V.ADS_SQL}, p AS (
  SELECT item_seq_number, count(*) AS n, avg(price) AS av, median(price) AS md, stddev_samp(price) AS sd,
         max(price) AS mx, min(price) AS mn FROM ads GROUP BY 1)
SELECT item_id, a.item_seq_number, n AS "count", round(av, 6) AS price_mean, round(md, 6) AS price_median,
       round(sd, 6) AS price_std, mx AS price_max, mn AS price_min
FROM ads a LEFT JOIN p ON a.item_seq_number = p.item_seq_number""")
def d4(spark, sf):
    a = V.ads(spark, sf, "item_id", "item_seq_number", "price")
    return round_doubles(enrich(a.select("item_id", "item_seq_number"),
                                P.value_profile(a, "item_seq_number", "price"), "item_seq_number"))


@query("d5_user_value_stats", f"""
WITH {V.ADS_SQL}
SELECT user_id, round(avg(price), 6) AS price_mean, round(median(price), 6) AS price_median,
       round(stddev_samp(price), 6) AS price_std, min(price) AS price_min, max(price) AS price_max
FROM ads GROUP BY 1""")
def d5(spark, sf):
    return round_doubles(P.user_value_stats(V.ads(spark, sf, "user_id", "price"), "user_id", "price"))


@query("d6_user_activity", """
SELECT user_id, count(*) AS user_count,
       CAST(date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS INT) AS user_period,
       round(date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) / count(*), 6) AS user_average_period
FROM events GROUP BY 1""")
def d6(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    return round_doubles(P.user_activity(e, "user_id", "day"))


@query("d7_user_weekday_profile", """
SELECT user_id, CAST(isodow(ts) - 1 AS INT) AS weekday, count(*) AS "count", round(median("value"), 6) AS value_median,
       round(stddev_samp("value"), 6) AS value_std, max("value") AS value_max, min("value") AS value_min
FROM events GROUP BY 1, 2""")
def d7(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    return round_doubles(P.user_weekday_profile(e, "user_id", "day", "value"))


_DIV = ["region", "city", "parent_category_name", "category_name", "param_1", "param_2", "user_type", "image_top_1"]


@query("d8_user_diversity", f"WITH {V.ADS_SQL} SELECT user_id, " + ", ".join(
    f"count(DISTINCT coalesce(CAST({c} AS VARCHAR), '_NAN_')) AS {c}_nunique" for c in _DIV) + " FROM ads GROUP BY 1")
def d8(spark, sf):
    return P.user_diversity(V.ads(spark, sf, "user_id", *_DIV), "user_id", _DIV)


@query("d9_user_extremes", f"""
WITH {V.ADS_SQL} SELECT user_id, max(item_seq_number) AS item_seq_number_max, min(item_seq_number) AS item_seq_number_min
FROM ads GROUP BY 1""")
def d9(spark, sf):
    return P.user_extremes(V.ads(spark, sf, "user_id", "item_seq_number"), "user_id", "item_seq_number")


_IP = """ip AS (SELECT item_id, CAST(sum(date_to - date_from) AS BIGINT) AS days_up_sum, count(*) AS times_put_up,
  max(date_to - date_from) AS days_up_max, min(date_to - date_from) AS days_up_min, avg(date_to - date_from) AS days_up_mean,
  CAST(sum(date_from - activation_date) AS BIGINT) AS days_wait_sum FROM periods GROUP BY 1)"""


@query("d10_item_periods", f"""
WITH {V.PERIODS_SQL}, {_IP}
SELECT item_id, days_up_sum, times_put_up, CAST(days_up_max AS INT) AS days_up_max, CAST(days_up_min AS INT) AS days_up_min,
       round(days_up_mean, 6) AS days_up_mean FROM ip""")
def d10(spark, sf):
    return round_doubles(P.item_periods(V.periods(spark, sf)))


@query("d11_user_periods", f"""
WITH {V.PERIODS_SQL}, {V.ITEMS_SQL}, {_IP},
u AS (SELECT user_id, avg(days_up_sum) AS a, avg(times_put_up) AS b, max(days_up_sum) AS c, min(days_up_sum) AS d,
             max(times_put_up) AS e, min(times_put_up) AS f FROM ip JOIN items USING (item_id) GROUP BY 1),
n AS (SELECT user_id, count(DISTINCT item_id) AS n FROM items GROUP BY 1)
SELECT coalesce(u.user_id, n.user_id) AS user_id, round(a, 6) AS avg_days_up_user, round(b, 6) AS avg_times_up_user,
       c AS max_days_up_user, d AS min_days_up_user, e AS max_times_up_user, f AS min_times_up_user, n AS n_user_items
FROM u FULL JOIN n ON u.user_id = n.user_id""")
def d11(spark, sf):
    return round_doubles(P.user_periods(V.periods(spark, sf), V.items(spark, sf)))


@query("d12_user_wait", f"""
WITH {V.PERIODS_SQL}, {V.ITEMS_SQL}, {_IP}
SELECT user_id, round(avg(days_wait_sum), 6) AS avg_days_wait_user, round(avg(times_put_up), 6) AS avg_times_wait_user
FROM ip JOIN items USING (item_id) GROUP BY 1""")
def d12(spark, sf):
    return round_doubles(P.user_wait(V.periods(spark, sf), V.items(spark, sf)))


@query("d13_group_days_up", f"""
WITH {V.PERIODS_SQL}, {_IP}, i AS (SELECT o_orderkey AS item_id, o_orderpriority AS grp FROM orders)
SELECT grp, round(avg(days_up_mean), 6) AS days_up_mean, round(stddev_samp(days_up_mean), 6) AS days_up_std,
       round(max(days_up_mean), 6) AS days_up_max, round(min(days_up_mean), 6) AS days_up_min
FROM i LEFT JOIN ip ON i.item_id = ip.item_id GROUP BY 1""")
def d13(spark, sf):
    it = V.table(spark, sf, "orders").selectExpr("o_orderkey AS item_id", "o_orderpriority AS grp")
    return round_doubles(P.group_days_up(V.periods(spark, sf), it, "grp"))


@query("d14_weekday_median", f"""
WITH {V.ADS_SQL}, m AS (SELECT {_W} AS w, median(price) AS md FROM ads GROUP BY 1)
SELECT item_id, CAST({_W} AS INT) AS weekday, round(md, 6) AS weekday_price_median
FROM ads JOIN m ON m.w = {_W}""")
def d14(spark, sf):
    a = V.ads(spark, sf, "item_id", "activation_date", "price")
    return round_doubles(P.weekday_median(a, "activation_date", "price")
                         .select("item_id", "weekday", "weekday_price_median"))


_GRID_K, _GRID_V = ["category_name", "image_top_1", "param_2"], ["price", "target"]


@query("d24_stat_grid", f"WITH {V.ADS_SQL} " + " UNION ALL ".join(
    f"SELECT '{k}' AS key_name, CAST({k} AS VARCHAR) AS key, '{v}' AS value_name, count({v}) AS n,"
    f" round(median({v}), 6) AS median FROM ads WHERE {k} IS NOT NULL GROUP BY {k}"
    for k in _GRID_K for v in _GRID_V))
def d24(spark, sf):
    return round_doubles(P.stat_grid(V.ads(spark, sf, *_GRID_K, *_GRID_V), _GRID_K, _GRID_V))


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("d25_crosstab", f"WITH {V.ADS_SQL} SELECT category_name, " + ", ".join(
    f"count(*) FILTER (user_type = '{s}') AS {s}" for s in _SEG) + " FROM ads WHERE user_type IS NOT NULL GROUP BY 1")
def d25(spark, sf):
    return P.crosstab(V.ads(spark, sf, "category_name", "user_type"), "category_name", "user_type", _SEG)


@query("d25_crosstab_long", f"""
WITH {V.ADS_SQL} SELECT category_name, user_type, count(*) AS n FROM ads
WHERE category_name IS NOT NULL AND user_type IS NOT NULL GROUP BY 1, 2""")
def d25_long(spark, sf):
    return P.crosstab_long(V.ads(spark, sf, "category_name", "user_type"), "category_name", "user_type")


@query("d26_value_counts", f"WITH {V.ADS_SQL} SELECT target, count(*) AS n FROM ads GROUP BY 1")
def d26(spark, sf):
    return P.value_counts(V.ads(spark, sf, "target"), "target")


@query("d31_histogram", """
WITH f AS (SELECT CAST(least(floor((l_extendedprice - 0) / (110000.0::DOUBLE / 255)), 254) AS INT) AS bin, count(*) AS n
FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 110000 GROUP BY 1)
SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n FROM range(255) t(b) LEFT JOIN f ON bin = b""")
def d31(spark, sf):
    return P.histogram(V.table(spark, sf, "lineitem"), "l_extendedprice", 0.0, 110000.0, 255)


@query("d31_row_histogram", """
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT vec_id, CAST(least(floor((x + 1) / (2.0::DOUBLE / 255)), 254) AS INT) AS bin, count(*) AS n FROM v WHERE x BETWEEN -1 AND 1 GROUP BY 1, 2)
SELECT vec_id, list_transform(range(255), lambda b: CAST(coalesce(list_extract(map_extract(m, CAST(b AS INT)), 1), 0) AS BIGINT)) AS histogram
FROM (SELECT vec_id, map(list(bin), list(n)) AS m FROM c GROUP BY 1)""")
def d31_rows(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return P.row_histogram(e, "vec_id", "embedding", -1.0, 1.0, 255)


_GAINS = "SELECT p_name AS feature, sum(l_extendedprice) AS gain FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"


@query("d32_importance_share", f"""
WITH g AS ({_GAINS})
SELECT feature, round(gain, 6) AS gain, round(100 * gain / (SELECT sum(gain) FROM g), 6) AS share
FROM g ORDER BY share DESC, feature LIMIT 50""")
def d32(spark, sf):
    g = (V.table(spark, sf, "lineitem").join(V.table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
         .groupBy(F.col("p_name").alias("feature")).agg(F.sum("l_extendedprice").alias("gain")))
    return round_doubles(P.importance_share(g, 50))


_FLAGS = ", ".join(f"CAST((({d} - (isodow(date_from) - 1) + 7) % 7) <= date_to - date_from AS INT) AS on_{n}"
                   for d, n in enumerate(P.WEEKDAYS))


@query("d33_weekday_on_shelf", f"""
WITH {V.PERIODS_SQL}, e AS (
  SELECT item_id, line, image_top_1, date_from, date_to,
         unnest(generate_series(date_from::TIMESTAMP, date_to::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM periods)
SELECT item_id, line, image_top_1, date_from, date_to, """ + ", ".join(
    f"max(CAST(isodow(d) = {d + 1} AS INT)) AS on_{n}" for d, n in enumerate(P.WEEKDAYS))
    + ", count(*) AS n FROM e GROUP BY 1, 2, 3, 4, 5")
def d33(spark, sf):
    keys = ["item_id", "line", "image_top_1", "date_from", "date_to"]
    # identical period rows fall together, as in the expansion by day; nearly all differ, so a task gets a stated number of them
    flagged = P.weekday_on_shelf(spread(V.periods(spark, sf).select(*keys), keys, P.TASK_ROWS))
    return flagged.groupBy(*keys).agg(
        *[F.max(f"on_{n}").alias(f"on_{n}") for n in P.WEEKDAYS],
        F.sum(F.datediff("date_to", "date_from") + 1).alias("n"))


@query("d33_weekday_code_sums", f"WITH {V.PERIODS_SQL}, f AS (SELECT image_top_1, {_FLAGS} FROM periods) "
       + " UNION ALL ".join(f"SELECT '{n}' AS weekday, {f} AS flag, CAST(sum(image_top_1) FILTER (on_{n} = {f}) AS BIGINT) AS total FROM f"
                            for n in P.WEEKDAYS for f in (0, 1)))
def d33_sums(spark, sf):
    return P.weekday_code_sums(P.weekday_on_shelf(V.periods(spark, sf)), "image_top_1")
