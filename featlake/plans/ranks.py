"""Rank, label, vocabulary and running-total queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.operators import ordering as O
from featlake.operators import ranks as R
from featlake.plans.registry import query, r6, round_doubles
from featlake.sources import views as V


@query("e1_rank_avg", f"""
WITH {V.ADS_SQL}, a AS (SELECT *, coalesce(price, -1) AS v FROM ads)
SELECT item_id, rank() OVER (PARTITION BY split, category_name ORDER BY v DESC)
  + (count(*) OVER (PARTITION BY split, category_name, v) - 1) / 2.0::DOUBLE AS price_rank FROM a""")
def e1(spark, sf):
    a = V.ads(spark, sf, "item_id", "split", "category_name", "price")
    return R.rank_avg(a, "price", ["split", "category_name"], "price_rank").select("item_id", "price_rank")


_LBL = ["region", "city", "category_name", "param_1", "user_type", "user_id"]


@query("e2_label_encode", f"WITH {V.ADS_SQL} SELECT item_id, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({c} AS VARCHAR), 'nan')) - 1 AS INT) AS {c}" for c in _LBL) + " FROM ads")
def e2(spark, sf):
    return R.label_encode(V.ads(spark, sf, "item_id", *_LBL), _LBL)


@query("e3_dedupe_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
WHERE rn = 1""")
def e3(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return R.dedupe_first(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("e4_gauss_rank", """
WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
x AS (SELECT *, i / ((n - 1) / (2 * (1 - 0.001::DOUBLE))) - (1 - 0.001::DOUBLE) AS x FROM r)
SELECT o_orderkey, o_totalprice, round(""" + R.erfinv_sql("x") + ", 6) AS scaled FROM x")
def e4(spark, sf):
    return round_doubles(R.gauss_rank(V.table(spark, sf, "orders"), "o_totalprice", "o_orderkey", "scaled"))


@query("e5_build_vocab", """
WITH t AS (SELECT tok, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS tok FROM documents) WHERE tok <> '' GROUP BY 1)
SELECT tok, n, row_number() OVER (ORDER BY n DESC, tok) AS id FROM t ORDER BY id LIMIT 5000""")
def e5(spark, sf):
    toks = V.table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("tok")).where("tok <> ''")
    return R.build_vocab(toks, "tok", 5000)


@query("e6_cumulative", """
WITH g AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT o_custkey, round(v, 6) AS v, round(sum(v) OVER (ORDER BY v DESC, o_custkey ROWS UNBOUNDED PRECEDING) / (SELECT sum(v) FROM g), 6) AS share
FROM g""")
def e6(spark, sf):
    g = V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 4).alias("v"))
    total = g.agg(F.sum("v")).scalar()
    run = O.cumulative(g, "v", [F.desc("v"), F.asc("o_custkey")], "_run")
    return run.select("o_custkey", r6("v").alias("v"), r6(F.col("_run") / total).alias("share"))
