"""Numeric and date function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.functions import dates as D
from featlake.functions import numeric as N
from featlake.plans.registry import query, r6
from featlake.sources import views as V


@query("h1_log_shift", f"""
WITH {V.ADS_SQL} SELECT item_id, round(ln(price + 0.001), 6) AS log_price, round(CASE WHEN target - 0.1 > 0 THEN ln(target - 0.1) END, 6) AS log_target,
  round(exp(ln(price + 0.0001)) - 0.0001, 4) AS price_back FROM ads""")
def h1(spark, sf):
    p = F.col("price")
    return V.ads(spark, sf, "item_id", "price", "target").select(
        "item_id", r6(N.log_shift(p)).alias("log_price"), r6(N.log_shift(F.col("target"), -0.1)).alias("log_target"),
        F.round(N.exp_shift(N.log_shift(p, 0.0001)), 4).alias("price_back"))


@query("h2_log1p_log2", f"""
WITH {V.ADS_SQL} SELECT item_id, round(ln(1 + price), 6) AS log1p_price, CAST(trunc(log2(1 + price)) AS INT) AS log2_price FROM ads""")
def h2(spark, sf):
    p = F.col("price")
    return V.ads(spark, sf, "item_id", "price").select(
        "item_id", r6(F.log1p(p)).alias("log1p_price"), N.log2_int(p).alias("log2_price"))


@query("h3_log_bucket", f"""
WITH {V.ADS_SQL} SELECT item_id, """ + ", ".join(
    f"CAST(round_even(ln(price + 0.001) * {f}, 0) AS INT) AS price_bucket_{str(f).replace('.', '_')}" for f in (2.8, 3.5, 4.0, 4.8))
    + ", CAST(round_even(user_id / 100.0, 0) AS INT) AS user_bucket FROM ads")
def h3(spark, sf):
    lp = N.log_shift(F.col("price"))
    return V.ads(spark, sf, "item_id", "price", "user_id").select(
        "item_id", *[N.log_bucket(lp, f).alias(f"price_bucket_{str(f).replace('.', '_')}") for f in (2.8, 3.5, 4.0, 4.8)],
        N.round_bucket(F.col("user_id"), 100.0).alias("user_bucket"))


@query("h4_length_code", """
SELECT doc_id, CASE WHEN length(text) > 0 THEN CAST(trunc(ln(length(text)) * 4) AS INT) END AS len_code,
       CAST(trunc(ln(1 + len(string_split(text, ' '))) * 20) AS INT) AS words_code FROM documents""")
def h4(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", N.length_code(F.length("text"), 4).alias("len_code"),
        N.length_code(F.size(F.split("text", " ")), 20, plus_one=True).alias("words_code"))


_CUTS = [*N.PRICE_CUTS]
_CLUSTER = ("CASE WHEN price IS NULL THEN 8 " + " ".join(f"WHEN price < {c} THEN {i}" for i, c in enumerate(_CUTS, 1)) + " ELSE 7 END")
_CLUSTERED = f"{V.ADS_SQL}, c AS (SELECT item_id, price, {_CLUSTER} AS cl FROM (SELECT item_id, CASE WHEN item_seq_number % 3 = 0 THEN price / 100 ELSE price END AS price FROM ads))"


def _mixed(spark, sf):
    return V.ads(spark, sf, "item_id", "price", "item_seq_number").select(
        "item_id", F.when(F.col("item_seq_number") % 3 == 0, F.col("price") / 100).otherwise(F.col("price")).alias("price"))


@query("h5_price_cluster", f"WITH {_CLUSTERED} SELECT item_id, cl AS cluster FROM c")
def h5(spark, sf):
    return _mixed(spark, sf).select("item_id", N.price_cluster(F.col("price")).alias("cluster"))


@query("h6_price_parity_onehot", f"""
WITH {_CLUSTERED}, p AS (SELECT item_id, cl, CASE WHEN cl = 8 THEN 0
   WHEN (CAST(trunc(price / ([500, 1000, 5000, 10000, 50000, 100000, 1000000, 1][cl] / 20.0::DOUBLE)) AS BIGINT) + 1) % 2 = 0 THEN -1 ELSE 1 END AS par FROM c)
SELECT item_id, """ + ", ".join(f"CASE WHEN cl = {i} THEN par ELSE 0 END AS price_bin_feature_{i}" for i in range(1, 9)) + " FROM p")
def h6(spark, sf):
    return _mixed(spark, sf).select("item_id", *N.price_parity_onehot(F.col("price")))


@query("h8_hash_bucket", f"SELECT p_partkey, CAST({V.sql_hash60('p_name')} % 15000 AS INT) AS bucket FROM part")
def h8(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", N.hash_bucket(F.col("p_name"), 15000).alias("bucket"))


@query("h9_param_hash", f"WITH {V.ADS_SQL} SELECT item_id, CAST(trunc(price / 500) AS INT) * image_top_1 AS param_hash FROM ads")
def h9(spark, sf):
    return V.ads(spark, sf, "item_id", "price", "image_top_1").select(
        "item_id", N.param_hash(F.col("price"), F.col("image_top_1")).alias("param_hash"))


@query("h10_sigmoid", f"WITH {V.ADS_SQL} SELECT item_id, round(1 / (1 + exp(-target)), 6) AS s FROM ads")
def h10(spark, sf):
    return V.ads(spark, sf, "item_id", "target").select("item_id", r6(N.sigmoid(F.col("target"))).alias("s"))


@query("t1_weekday", "SELECT event_id, CAST(isodow(ts) - 1 AS INT) AS weekday FROM events")
def t1(spark, sf):
    return V.table(spark, sf, "events").select("event_id", D.weekday(F.col("ts")).alias("weekday"))


@query("t2_calendar_parts", """
SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(dayofyear(ts) AS INT) AS day_of_year, CAST(weekofyear(ts) AS INT) AS week,
       CAST(day(ts) AS INT) AS day, CAST(quarter(ts) AS INT) AS quarter FROM events""")
def t2(spark, sf):
    return V.table(spark, sf, "events").select("event_id", *D.calendar_parts(F.col("ts")))


@query("t3_days_between", f"WITH {V.PERIODS_SQL} SELECT item_id, line, CAST(date_to - date_from AS INT) AS days_up, CAST(date_from - activation_date AS INT) AS wait FROM periods")
def t3(spark, sf):
    return V.periods(spark, sf).select("item_id", "line", D.days_between(F.col("date_to"), F.col("date_from")).alias("days_up"),
                                       D.days_between(F.col("date_from"), F.col("activation_date")).alias("wait"))


@query("t4_end_weekday", f"""
WITH {V.PERIODS_SQL} SELECT item_id, line, coalesce(CASE WHEN item_id % 5 > 0 THEN date_to END, DATE '1999-04-01') AS date_to,
  CAST(isodow(coalesce(CASE WHEN item_id % 5 > 0 THEN date_to END, DATE '1999-04-01')) - 1 AS INT) AS end_weekday FROM periods""")
def t4(spark, sf):
    holed = F.when(F.col("item_id") % 5 > 0, F.col("date_to"))
    p = V.periods(spark, sf).select("item_id", "line", D.fill_date(holed, "1999-04-01").alias("date_to"))
    return D.end_weekday(p, "date_to")


@query("t5_expand_dates", f"""
WITH {V.PERIODS_SQL} SELECT day, count(*) AS n FROM (
  SELECT CAST(unnest(generate_series(date_from::TIMESTAMP, date_to::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM periods) GROUP BY 1""")
def t5(spark, sf):
    return D.expand_dates(V.periods(spark, sf), "date_from", "date_to").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
