"""Projection, filter and null-handling queries (B1-B22), set operations (U1-U4) and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.functions import numeric as N
from featlake.operators import columns as C
from featlake.operators import sampling as G
from featlake.plans.registry import query, r6, round_doubles
from featlake.sources import views as V


@query("b1_drop_columns", "SELECT p_partkey, p_name, p_size FROM part")
def b1(spark, sf):
    return C.drop_columns(V.table(spark, sf, "part"), ["p_brand", "p_type", "p_retailprice"])


@query("b2_prune_listed", """
SELECT l_orderkey, l_partkey, l_discount, l_tax FROM lineitem""")
def b2(spark, sf):
    li = V.table(spark, sf, "lineitem")
    # features whose mean is above 3.5 play the part of the listed ones
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    means = li.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return C.prune_listed(li, [c for c in cols if means[c] > 3.5] + ["l_suppkey", "l_returnflag", "l_linestatus",
                                                                     "l_shipdate", "absent"])


@query("b2b_zero_gain", """
SELECT p_name AS feature FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING avg(l_discount) * 20 < 1""")
def b2b(spark, sf):
    gains = (V.table(spark, sf, "lineitem").join(V.table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
             .groupBy("p_name").agg((F.avg("l_discount") * 20).alias("gain")))
    doc = gains.select(F.to_json(F.create_map("p_name", "gain")).alias("js"))
    return C.zero_gain(C.importance_from_json(doc, "js"))


@query("b3_prune_pattern", "SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def b3(spark, sf):
    return C.prune_pattern(V.table(spark, sf, "lineitem"), ["key$", "number$", "^l_ext", "date"])


@query("b4_drop_null_columns", f"WITH {V.ADS_SQL} SELECT item_id, category_name, target FROM ads")
def b4(spark, sf):
    return C.drop_null_columns(V.ads(spark, sf, "item_id", "category_name", "param_1", "price", "image_top_1", "target"))


@query("b5_drop_null_rows", f"""
WITH {V.ADS_SQL} SELECT item_id, price, param_1 FROM ads WHERE price IS NOT NULL AND param_1 IS NOT NULL""")
def b5(spark, sf):
    return C.drop_null_rows(V.ads(spark, sf, "item_id", "price", "param_1"), ["price", "param_1"])


@query("b6_split_known", f"""
WITH {V.ADS_SQL} SELECT item_id, CASE WHEN price IS NULL THEN 'predict' ELSE 'fit' END AS part FROM ads""")
def b6(spark, sf):
    known, unknown = C.split_known(V.ads(spark, sf, "item_id", "price"), "price")
    return (known.select("item_id", F.lit("fit").alias("part"))
            .unionByName(unknown.select("item_id", F.lit("predict").alias("part"))))


@query("b7_split_by_date", """
SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1997-06-30' THEN 'train' ELSE 'valid' END AS part
FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1997-06-30' OR CAST(o_orderdate AS DATE) >= DATE '1997-08-01'""")
def b7(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    a, b = C.split_by_date(o, "d", "1997-06-30", "1997-08-01")
    return (a.select("o_orderkey", F.lit("train").alias("part"))
            .unionByName(b.select("o_orderkey", F.lit("valid").alias("part"))))


@query("b8_mark_split", f"WITH {V.ADS_SQL} SELECT item_id, CASE WHEN split = 'train' THEN target END AS target, split FROM ads")
def b8(spark, sf):
    a = V.ads(spark, sf, "item_id", "target", "split")
    train = C.take_split(a, "train")
    return C.mark_split(train, C.take_split(a, "test").drop("target"))


@query("b9_fill_const", f"""
WITH {V.ADS_SQL} SELECT item_id, coalesce(price, -1) AS price, coalesce(param_1, 'unknown') AS param_1,
       coalesce(image_top_1, -1) AS image_top_1 FROM ads""")
def b9(spark, sf):
    return C.fill_const(V.ads(spark, sf, "item_id", "price", "param_1", "image_top_1"),
                        {"price": -1.0, "param_1": "unknown", "image_top_1": -1})


@query("b10_coalesce_cols", f"WITH {V.ADS_SQL} SELECT item_id, coalesce(image_top_1, item_seq_number) AS code FROM ads")
def b10(spark, sf):
    return V.ads(spark, sf, "item_id", "image_top_1", "item_seq_number").select(
        "item_id", C.coalesce_cols("image_top_1", "item_seq_number").alias("code"))


@query("b11_null_flags", f"""
WITH {V.ADS_SQL} SELECT item_id, CAST(price IS NULL AS INT) AS price_null, CAST(param_1 IS NULL AS INT) AS param_1_null,
  CAST(image_top_1 IS NULL AS INT) AS image_top_1_null,
  CAST(price IS NULL AS INT) + CAST(param_1 IS NULL AS INT) + CAST(image_top_1 IS NULL AS INT) AS n_null FROM ads""")
def b11(spark, sf):
    return C.null_flags(V.ads(spark, sf, "item_id", "price", "param_1", "image_top_1"),
                        ["price", "param_1", "image_top_1"]).drop("price", "param_1", "image_top_1")


@query("b12_replace_inf", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
       round(CASE WHEN l_discount = 0 THEN 9999 WHEN l_tax = 0 THEN -9999 ELSE l_tax / l_discount END, 6) AS x FROM lineitem""")
def b12(spark, sf):
    inf = F.lit(float("inf"))
    x = F.when(F.col("l_discount") == 0, inf).when(F.col("l_tax") == 0, -inf).otherwise(F.try_divide("l_tax", "l_discount"))
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                                 r6(N.replace_inf(x, 9999.0, -9999.0)).alias("x"))


@query("b13_downcast", f"""
WITH {V.ADS_SQL} SELECT item_id, CAST(item_seq_number AS TINYINT) AS item_seq_number, TRY_CAST(user_id AS SMALLINT) AS user_id,
 CAST(target AS REAL) AS target FROM ads""")
def b13(spark, sf):
    return C.downcast(V.ads(spark, sf, "item_id", "item_seq_number", "user_id", "target"),
                      {"item_seq_number": "byte", "user_id": "short", "target": "float"})


@query("b14_clip", f"WITH {V.ADS_SQL} SELECT item_id, CASE WHEN price IS NOT NULL THEN least(greatest(price, 5000), 50000) END AS price FROM ads")
def b14(spark, sf):
    return V.ads(spark, sf, "item_id", "price").select("item_id", N.clip(F.col("price"), 5000.0, 50000.0).alias("price"))


@query("b15_binarise", f"WITH {V.ADS_SQL} SELECT item_id, CAST(target = 0 AS INT) AS is_zero, CAST(target >= 0.55 AS INT) AS is_high FROM ads")
def b15(spark, sf):
    t = F.col("target")
    return V.ads(spark, sf, "item_id", "target").select(
        "item_id", N.binarise(t, "==", 0).alias("is_zero"), N.binarise(t, ">=", 0.55).alias("is_high"))


_WORDS = {"has_the": "the", "has_upper": "Elle", "has_und": " und ", "has_2": "2"}


@query("b16_keyword_flags", "SELECT doc_id, " + ", ".join(
    f"CAST(contains(text, '{w}') AS INT) AS {n}" for n, w in _WORDS.items()) + " FROM documents")
def b16(spark, sf):
    return C.keyword_flags(V.table(spark, sf, "documents").select("doc_id", "text"), "text", _WORDS).drop("text")


@query("b17_presence_flag", f"WITH {V.ADS_SQL} SELECT item_id, CAST(param_1 IS NOT NULL AND length(param_1) > 0 AS INT) AS has_param FROM ads")
def b17(spark, sf):
    return V.ads(spark, sf, "item_id", "param_1").select("item_id", N.presence_flag(F.col("param_1")).alias("has_param"))


@query("b18_ratio", f"""
WITH {V.ADS_SQL}, {V.INCOMES_SQL}
SELECT item_id, round(coalesce(price / income, -1), 6) AS price_vs_income FROM ads LEFT JOIN incomes ON ads.town = incomes.town""")
def b18(spark, sf):
    from featlake.operators.joins import lookup
    a = lookup(V.ads(spark, sf, "item_id", "town", "price"), V.incomes(spark, sf), "town")
    return a.select("item_id", r6(N.ratio(F.col("price"), F.col("income"), -1.0)).alias("price_vs_income"))


@query("b19_interact", f"WITH {V.ADS_SQL} SELECT item_id, item_seq_number * image_top_1 AS product FROM ads")
def b19(spark, sf):
    return V.ads(spark, sf, "item_id", "item_seq_number", "image_top_1").select(
        "item_id", N.interact(F.col("item_seq_number"), F.col("image_top_1")).alias("product"))


@query("b20_concat_key", f"""
WITH {V.ADS_SQL} SELECT item_id, city || '_' || region || '_' || coalesce(param_1, 'nan') AS place FROM ads""")
def b20(spark, sf):
    return V.ads(spark, sf, "item_id", "city", "region", "param_1").select(
        "item_id", N.concat_key([F.col("city"), F.col("region"), F.col("param_1")]).alias("place"))


@query("b21_add_cols", "SELECT p_partkey, round(p_size + p_retailprice, 6) AS total FROM part")
def b21(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", r6(N.add_cols(F.col("p_size"), F.col("p_retailprice"))).alias("total"))


@query("b22_fill_max_plus_one", f"""
WITH {V.ADS_SQL} SELECT item_id, coalesce(image_top_1, (SELECT max(image_top_1) + 1 FROM ads)) AS image_top_1 FROM ads""")
def b22(spark, sf):
    return C.fill_max_plus_one(V.ads(spark, sf, "item_id", "image_top_1"), "image_top_1")


@query("u1_union_all", """
SELECT o_orderkey AS item_id, o_custkey AS user_id, NULL::VARCHAR AS kind FROM orders
UNION ALL SELECT event_id, user_id, event_type FROM events""")
def u1(spark, sf):
    return C.union_all(
        V.table(spark, sf, "orders").selectExpr("o_orderkey AS item_id", "o_custkey AS user_id"),
        V.table(spark, sf, "events").selectExpr("event_id AS item_id", "user_id", "event_type AS kind"))


@query("u2_distinct_key", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def u2(spark, sf):
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates(["l_orderkey", "l_linenumber"])


@query("u3_union_distinct", "SELECT o_custkey AS user_id FROM orders UNION SELECT user_id FROM events")
def u3(spark, sf):
    return C.union_distinct(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")),
                            V.table(spark, sf, "events").select("user_id"))


@query("u4_column_difference", "SELECT p_partkey, p_size, p_retailprice FROM part")
def u4(spark, sf):
    p = V.table(spark, sf, "part")
    text = [c for c, t in p.dtypes if t == "string"]
    return p.select(*C.column_difference(p, text))


@query("g1_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def g1(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return li.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50)


_H = V.sql_hash60


@query("g3_sample_n", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_H(chr(39) + 's7' + chr(39) + ' || o_orderkey')}, o_orderkey LIMIT 500")
def g3(spark, sf):
    return G.sample_n(V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, "s7")


@query("g4_assign_fold", f"WITH {V.ADS_SQL} SELECT item_id, fold FROM ads")
def g4(spark, sf):
    return G.assign_fold(V.ads(spark, sf, "item_id"), "item_id", 5)


@query("g4_holdout", f"""
SELECT o_orderkey, CASE WHEN {_H(chr(39) + 'holdout' + chr(39) + ' || o_orderkey')} % 10000 < 1000 THEN 'valid' ELSE 'train' END AS part FROM orders""")
def g4_holdout(spark, sf):
    a, b = G.holdout(V.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.1)
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("valid")))


@query("h7_standardise", f"""
WITH {V.ADS_SQL}, s AS (SELECT avg(price) AS m, stddev_pop(price) AS d, avg(item_seq_number) AS m2, stddev_pop(item_seq_number) AS d2 FROM ads)
SELECT item_id, round(coalesce((price - m) / d, 0), 6) AS price, round((item_seq_number - m2) / d2, 6) AS item_seq_number
FROM ads, s""")
def h7(spark, sf):
    a = V.ads(spark, sf, "item_id", "price", "item_seq_number")
    return round_doubles(C.standardise(a, ["price", "item_seq_number"], mask_null=True))


@query("h11_scale_target", f"""
WITH {V.ADS_SQL}, s AS (SELECT avg(ln(1 + target)) AS m, stddev_pop(ln(1 + target)) AS d FROM ads)
SELECT item_id, round((ln(1 + target) - m) / d, 6) AS scaled, round(target, 6) AS back FROM ads, s""")
def h11(spark, sf):
    a = V.ads(spark, sf, "item_id", "target")
    s = C.scale_target(a, "target", "scaled")
    return round_doubles(C.unscale(s, "scaled", a, "target", "back").select("item_id", "scaled", "back"))
