"""Join queries (C1-C12) and the blends that build on nearest-value joins (K4, K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.functions import numeric as N
from featlake.operators import joins as J
from featlake.operators import profiles as P
from featlake.operators import snap as S
from featlake.plans.registry import query, round_doubles
from featlake.sources import views as V


@query("c1_enrich_small", f"""
WITH {V.ADS_SQL}, {V.INCOMES_SQL} SELECT item_id, ads.town, coalesce(income, -1) AS income FROM ads LEFT JOIN incomes ON ads.town = incomes.town""")
def c1(spark, sf):
    return J.lookup(V.ads(spark, sf, "item_id", "town"), V.incomes(spark, sf), "town", fill={"income": -1.0})


@query("c2_enrich_composite", f"""
WITH {V.ADS_SQL}, g AS (SELECT category_name, user_type, count(*) AS n, max(price) AS top FROM ads GROUP BY 1, 2)
SELECT item_id, n, top FROM ads JOIN g ON ads.category_name = g.category_name AND ads.user_type = g.user_type""")
def c2(spark, sf):
    a = V.ads(spark, sf, "item_id", "category_name", "user_type", "price")
    g = a.groupBy("category_name", "user_type").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("top"))
    return J.enrich(a, g, ["category_name", "user_type"]).select("item_id", "n", "top")


@query("c3_attach_side", """
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, key, s_acctbal FROM (SELECT *, CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN -l_suppkey ELSE l_suppkey END AS key FROM lineitem)
LEFT JOIN supplier ON key = s_suppkey""")
def c3(spark, sf):
    key = "CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN -l_suppkey ELSE l_suppkey END AS key"  # missing and unknown suppliers
    li = V.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", key)
    return J.attach_side(li, V.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "key", "s_suppkey")


@query("c4_outer_merge", """
WITH a AS (SELECT o_custkey AS user_id, count(*) AS n_orders FROM orders GROUP BY 1),
b AS (SELECT user_id, count(*) AS n_events FROM events GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, n_orders, n_events FROM a FULL JOIN b ON a.user_id = b.user_id""")
def c4(spark, sf):
    a = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = V.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return J.outer_merge(a, b, "user_id")


@query("c5_map_lookup", f"""
WITH {V.ADS_SQL}, {V.INCOMES_SQL} SELECT item_id, income AS city_income FROM ads LEFT JOIN incomes ON ads.town = incomes.town""")
def c5(spark, sf):
    return J.map_lookup(V.ads(spark, sf, "item_id", "town"), "town", V.incomes(spark, sf), "town", "income", "city_income").drop("town")


@query("c6_join_all", """
WITH a AS (SELECT o_custkey AS user_id, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT c_custkey AS user_id, c_acctbal, n, top, t.n_events FROM customer LEFT JOIN a ON c_custkey = a.user_id
LEFT JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY 1) t ON c_custkey = t.user_id""")
def c6(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    o = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    e = V.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return J.join_all([c, o, e], "user_id")


@query("c7_keep_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def c7(spark, sf):
    keys = V.table(spark, sf, "events").select(F.col("user_id").alias("o_custkey"))
    return J.keep_keys(V.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey").select("o_orderkey", "o_custkey")


@query("c8_periods_to_listings", f"""
WITH {V.PERIODS_SQL}, {V.ITEMS_SQL}, ip AS (SELECT item_id, sum(date_to - date_from) AS d FROM periods GROUP BY 1),
u AS (SELECT user_id, avg(d) AS avg_days_up_user FROM ip JOIN items USING (item_id) GROUP BY 1)
SELECT i.item_id, round(coalesce(avg_days_up_user, -1), 6) AS avg_days_up_user FROM items i LEFT JOIN u ON i.user_id = u.user_id""")
def c8(spark, sf):
    it = V.items(spark, sf)
    u = P.user_periods(V.periods(spark, sf), it).select("user_id", "avg_days_up_user")
    return round_doubles(J.enrich(it.select("item_id", "user_id"), u, "user_id", fill={"avg_days_up_user": -1.0}).drop("user_id"))


_NEAR = """
WITH {preds}, train AS (SELECT * FROM preds WHERE split = 'train'),
v AS (SELECT DISTINCT {g} AS g, target AS v FROM train WHERE {g} IS NOT NULL), x AS (SELECT DISTINCT {g} AS g, model_2 AS x FROM preds),
m AS (SELECT x.g, x, arg_min(v, {{'d': abs(x - v), 'v': v}}) AS s FROM x JOIN v ON x.g = v.g GROUP BY 1, 2)
"""


@query("c9_snap_nearest", _NEAR.format(preds=V.preds_sql(2), g="0")
       + "SELECT item_id, model_2, round(s, 6) AS snapped FROM preds JOIN m ON x = model_2")
def c9(spark, sf):
    p = V.preds(spark, sf, 2)
    return round_doubles(S.snap_nearest(p.select("item_id", "model_2"), "model_2", p.where("split = 'train'"), "target"))


_HASH = "CAST(trunc(price / 500) AS INT) * ascii(substr(param_2, 1, 1))"


def _hashed(spark, sf):
    return V.preds(spark, sf, 2, "price", "param_2").withColumn("param_hash", N.param_hash(F.col("price"), F.ascii(F.substring("param_2", 1, 1))))


@query("c10_snap_nearest_by", _NEAR.format(preds=V.preds_sql(2), g=_HASH)
       + f"SELECT item_id, model_2, round(coalesce(s, model_2), 6) AS snapped FROM preds LEFT JOIN m ON x = model_2 AND m.g = {_HASH}")
def c10(spark, sf):
    p = _hashed(spark, sf)
    return round_doubles(S.snap_nearest(p.select("item_id", "model_2", "param_hash"), "model_2",
                                        p.where("split = 'train'"), "target", by=["param_hash"]).drop("param_hash"))


@query("k4_snap_and_mix", _NEAR.format(preds=V.preds_sql(2), g=_HASH)
       + f"SELECT item_id, round(0.4 * coalesce(s, model_2) + 0.6 * model_2, 6) AS final FROM preds LEFT JOIN m ON x = model_2 AND m.g = {_HASH}")
def k4(spark, sf):
    p = _hashed(spark, sf)
    return round_doubles(S.snap_and_mix(p.select("item_id", "model_2", "param_hash"), "model_2",
                                        p.where("split = 'train'"), "target", by=["param_hash"]).select("item_id", "final"))


@query("k5_snap_by_category", _NEAR.format(preds=V.preds_sql(2), g="param_2")
       + "SELECT item_id, round(0.5 * coalesce(s, model_2) + 0.5 * model_2, 6) AS final FROM preds LEFT JOIN m ON x = model_2 AND m.g = param_2")
def k5(spark, sf):
    p = V.preds(spark, sf, 2, "param_2")
    return round_doubles(S.snap_and_mix(p.select("item_id", "model_2", "param_2"), "model_2", p.where("split = 'train'"),
                                        "target", by=["param_2"], weight=0.5).select("item_id", "final"))


@query("c12_assemble", f"WITH {V.ADS_SQL} SELECT item_id, price, target, user_type FROM ads")
def c12(spark, sf):
    a = V.ads(spark, sf, "item_id", "price", "target", "user_type")
    return J.assemble([a.select("item_id", "price"), a.select("item_id", "target"), a.select("item_id", "user_type")], "item_id")
