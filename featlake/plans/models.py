"""Model-backed queries."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from featlake.functions import text as T
from featlake.operators import blend as B
from featlake.operators import factors as FA
from featlake.operators import oof as O
from featlake.operators.encoders import target_encode_oof
from featlake.operators.vectorize import tfidf
from featlake.plans.registry import query, round_doubles
from featlake.plans.text import STOP
from featlake.session import settle
from featlake.sources import views as V

_NUM = ["price", "item_seq_number", "image_top_1", "user_id"]


def _rows(spark, sf):
    """Numeric features and target of the listings, train and test."""
    a = V.ads(spark, sf, "item_id", "fold", "split", "target", *_NUM).withColumnRenamed("target", "label")
    v = O.assemble_features(a, _NUM, ["item_id", "fold", "split", "label"])
    return v.where("split = 'train'").drop("split"), v.where("split = 'test'").drop("split")


def _score(df):
    """Key and prediction, the form in which predictions are stored."""
    return df.select("item_id", "oof")


@query("j1_oof_predict")
def j1(spark, sf):
    train, test = _rows(spark, sf)
    return _score(O.oof_predict(LinearRegression(regParam=0.01), train, "fold", test))


_SUMS = ["price", "item_seq_number"]


@query("j2_gram_sums", f"""
WITH {V.ADS_SQL} SELECT fold, count(*) AS n, sum(price) AS s_price, sum(item_seq_number)::DOUBLE AS s_seq, round(sum(target), 6) AS s_target,
  round(sum(price * price) / 1e6, 4) AS g_price_price, round(sum(price * item_seq_number) / 1e6, 4) AS g_price_seq, round(sum(price * target) / 1e3, 4) AS g_price_target,
  sum(item_seq_number * item_seq_number)::DOUBLE AS g_seq_seq, round(sum(item_seq_number * target), 4) AS g_seq_target, round(sum(target * target), 6) AS g_target_target
FROM ads WHERE price IS NOT NULL GROUP BY 1""".replace("sum(price) AS s_price", "round(sum(price), 4) AS s_price"))
def j2_sums(spark, sf):
    g = O.gram_sums(V.ads(spark, sf, "fold", "target", *_SUMS), _SUMS, "target", "fold")
    s, m = F.col("s"), F.col("g")
    return g.select("fold", "n", F.round(s[0], 4).alias("s_price"), s[1].alias("s_seq"), F.round(s[2], 6).alias("s_target"),
                    F.round(m[0] / 1e6, 4).alias("g_price_price"), F.round(m[1] / 1e6, 4).alias("g_price_seq"),
                    F.round(m[2] / 1e3, 4).alias("g_price_target"), m[3].alias("g_seq_seq"), F.round(m[4], 4).alias("g_seq_target"),
                    F.round(m[5], 6).alias("g_target_target"))


def _slope_sql(x, y, alpha, rel):
    """One-feature ridge per left-out fold in closed form."""
    return f"""s AS (SELECT fold, count(*)::DOUBLE AS n, sum({x})::DOUBLE AS sx, sum({y}) AS sy, sum({x} * {x})::DOUBLE AS sxx, sum({x} * {y}) AS sxy FROM {rel} GROUP BY 1),
o AS (SELECT a.fold, sum(b.n) AS n, sum(b.sx) AS sx, sum(b.sy) AS sy, sum(b.sxx) AS sxx, sum(b.sxy) AS sxy FROM s a JOIN s b ON a.fold <> b.fold GROUP BY 1),
m AS (SELECT fold, (sxy - sx * sy / n) / (sxx - sx * sx / n + {alpha}) AS w, sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n + {alpha}) * sx / n AS b FROM o)"""


@query("j2_ridge_oof", f"""
WITH {V.ADS_SQL}, train AS (SELECT * FROM ads WHERE split = 'train'), {_slope_sql('item_seq_number', 'target', 20, 'train')}
SELECT item_id, round(least(greatest(item_seq_number * w + b, 0), 1), 6) AS prediction FROM train JOIN m USING (fold)
UNION ALL SELECT item_id, round((SELECT avg(least(greatest(ads.item_seq_number * w + b, 0), 1)) FROM m), 6) FROM ads WHERE split = 'test'""")
def j2(spark, sf):
    a = V.ads(spark, sf, "item_id", "split", "fold", "target", "item_seq_number")
    out = O.ridge_oof(a.where("split = 'train'"), ["item_seq_number"], "target", "fold", 20.0, test=a.where("split = 'test'"))
    return round_doubles(out.select("item_id", "prediction"))


@query("j2_ridge_oof_wide")
def j2_wide(spark, sf):
    cols = ["item_seq_number", "image", "enc_category", "enc_user"]
    a = V.ads(spark, sf, "item_id", "category_name", "user_id", "fold", "split", "target", "item_seq_number", "image_top_1")
    a, test = a.where("split = 'train'"), a.where("split = 'test'")
    enc = target_encode_oof(a, "category_name", "target", "fold", "mean", "enc_category", test=test)
    enc = target_encode_oof(enc.where("split = 'train'"), "user_id", "target", "fold", "mean", "enc_user", test=enc.where("split = 'test'"))
    enc = settle(enc.select("item_id", "fold", "split", "target", "item_seq_number", F.coalesce("image_top_1", F.lit(-1)).alias("image"),
                            F.coalesce("enc_category", F.lit(0.5)).alias("enc_category"), F.coalesce("enc_user", F.lit(0.5)).alias("enc_user")))
    out = O.ridge_oof(enc.where("split = 'train'"), cols, "target", "fold", 20.0, test=enc.where("split = 'test'"))
    return out.select("item_id", "prediction")


@query("j3_linear_oof")
def j3(spark, sf):
    train, test = _rows(spark, sf)
    return _score(O.linear_oof(train, "fold", test, reg=0.001, l1_share=0.5))


@query("j4_onehot_oof")
def j4(spark, sf):
    cats = ["category_name", "city", "user_type", "param_1"]
    a = V.ads(spark, sf, "item_id", "fold", "split", "target", *cats).withColumnRenamed("target", "label")
    return _score(O.onehot_oof(a.where("split = 'train'").drop("split"), cats, ["item_id", "fold", "label"], "fold",
                               a.where("split = 'test'").drop("split")))


@query("j5_half_oof", f"""
WITH {V.ADS_SQL}, train AS (SELECT *, CAST((row_number() OVER (ORDER BY item_id) - 1) * 2 >= count(*) OVER () AS INT) AS half FROM ads WHERE split = 'train'),
h AS (SELECT item_id, item_seq_number, target, half AS fold FROM train), {_slope_sql('item_seq_number', 'target', 5, 'h')}
SELECT item_id, round(least(greatest(item_seq_number * w + b, 0), 1), 6) AS prediction FROM h JOIN m USING (fold)
UNION ALL SELECT item_id, round((SELECT avg(least(greatest(ads.item_seq_number * w + b, 0), 1)) FROM m), 6) FROM ads WHERE split = 'test'""")
def j5(spark, sf):
    a = V.ads(spark, sf, "item_id", "split", "target", "item_seq_number")
    out = O.half_oof(a.where("split = 'train'"), "item_id", ["item_seq_number"], "target", 5.0, a.where("split = 'test'"))
    return round_doubles(out.select("item_id", "prediction"))


@query("j6_fm_oof")
def j6(spark, sf):
    a = V.ads(spark, sf, "item_id", "fold", "split", "target", "item_seq_number", "image_top_1")
    a = a.select("item_id", "fold", "split", F.col("target").alias("label"), (F.col("item_seq_number") / 50).alias("seq"),
                 (F.col("image_top_1") / 50).alias("image"))
    v = O.assemble_features(a, ["seq", "image"], ["item_id", "fold", "split", "label"])
    return _score(O.fm_oof(v.where("split = 'train'").drop("split"), "fold", v.where("split = 'test'").drop("split")))


@query("j7_gbt_oof")
def j7(spark, sf):
    train, test = _rows(spark, sf)
    return _score(O.gbt_oof(train, "fold", test))


@query("j7_gbt_oof_stopped")
def j7_stopped(spark, sf):
    train, test = _rows(spark, sf)
    return O.boosted_oof(train, "fold", test).select("item_id", "oof", "rounds")


@query("j8_classify_oof")
def j8(spark, sf):
    d = V.docs(spark, sf)
    d = d.select(F.col("doc_id").alias("item_id"), F.col("quality").alias("label"),
                 F.expr(f"CAST(pmod({V.hash60('CAST(doc_id AS STRING)')}, 5) AS INT)").alias("fold"),
                 F.log1p("n_chars").alias("log_chars"), *T.text_stats(F.col("text"), "t"))
    cols = ["log_chars", "t_num_words", "t_num_unique_words", "t_words_vs_unique"]
    v = O.assemble_features(d, cols, ["item_id", "fold", "label"])
    return _score(O.classify_oof(v.where("label IS NOT NULL"), "fold", v.where("label IS NULL")))


@query("j8_classify_trees_oof")
def j8_trees(spark, sf):
    train, test = _rows(spark, sf)
    train = train.withColumn("label", (F.col("label") >= 0.55).cast("int"))
    return _score(O.classify_oof(train, "fold", test, kind="trees"))


@query("j9_predict_missing", f"""
WITH {V.ADS_SQL}, known AS (SELECT *, ln(price + 0.0001) AS y FROM ads WHERE price IS NOT NULL), {_slope_sql('item_seq_number', 'y', 20, 'known')},
p AS (SELECT item_id, price, exp(item_seq_number * w + b) - 0.0001 AS v FROM known JOIN m USING (fold)
UNION ALL SELECT item_id, price, exp((SELECT avg(ads.item_seq_number * w + b) FROM m)) - 0.0001 FROM ads WHERE price IS NULL)
SELECT item_id, round(v, 4) AS price_pred, round(coalesce(v - price, 0), 4) AS price_pred_diff FROM p""")
def j9(spark, sf):
    a = V.ads(spark, sf, "item_id", "fold", "price", "item_seq_number")
    p = O.predict_missing(a, ["item_seq_number"], "price", "fold", 20.0, "price_pred")
    return p.select("item_id", F.round("price_pred", 4).alias("price_pred"), F.round("price_pred_diff", 4).alias("price_pred_diff"))


@query("j12_stack_oof")
def j12(spark, sf):
    p = V.preds(spark, sf)
    names = [f"model_{m}" for m in range(1, 6)]
    stack = B.stack_matrix({m: p.select("item_id", F.col(m).alias("prediction")) for m in names}, "item_id", "prediction")
    full = settle(stack.join(p.select("item_id", "fold", "split", "target"), "item_id"))
    out = O.ridge_oof(full.where("split = 'train'"), names, "target", "fold", 1.0, test=full.where("split = 'test'"))
    return out.select("item_id", "split", "prediction")


@query("j12_stack_trees_oof")
def j12_trees(spark, sf):
    p = V.preds(spark, sf)
    names = [f"model_{m}" for m in range(1, 6)]
    v = O.assemble_features(p.withColumnRenamed("target", "label"), names, ["item_id", "fold", "split", "label"])
    return _score(O.gbt_oof(v.where("split = 'train'").drop("split"), "fold", v.where("split = 'test'").drop("split")))


@query("j12_stack_oof_stopped")
def j12_stopped(spark, sf):
    p = V.preds(spark, sf)
    v = O.assemble_features(p.withColumnRenamed("target", "label"), [f"model_{m}" for m in range(1, 6)], ["item_id", "fold", "split", "label"])
    out = O.boosted_oof(v.where("split = 'train'").drop("split"), "fold", v.where("split = 'test'").drop("split"))
    return out.select("item_id", "oof", "rounds")


@query("j13_seed_average")
def j13(spark, sf):
    train, test = _rows(spark, sf)
    return O.seed_average(train, "fold", [1, 2, 3], "item_id", test)


@query("j15_forest_oof")
def j15(spark, sf):
    train, test = _rows(spark, sf)
    return _score(O.forest_oof(train, "fold", test))


@query("i8_word_vectors")
def i8(spark, sf):
    toks = V.table(spark, sf, "documents").select("doc_id", T.tokenize(F.lower("text")).alias("toks"))
    return FA.word_vectors(toks, "doc_id", "toks", dim=16)


@query("i9_lda_embed")
def i9(spark, sf):
    return FA.lda_embed(V.ads(spark, sf, "category_name", "city"), "category_name", "city", 3)


@query("i10_nmf_embed")
def i10(spark, sf):
    return FA.nmf_embed(V.ads(spark, sf, "user_id", "category_name"), "user_id", "category_name", 3)


@query("i11_tfidf_nmf_by")
def i11(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "text", "lang")
    return FA.tfidf_nmf_by(d, "doc_id", "text", "lang", 5)


@query("i12_svd_embed")
def i12(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "text")
    w = tfidf(d, "doc_id", "text", min_df=3, max_df=0.9, max_features=5000, stopwords=STOP)
    zero = F.array(*[F.lit(0.0)] * 4)  # of a document without kept terms
    return d.select("doc_id").join(FA.svd_embed(w, "doc_id", "term", "weight", 4), "doc_id", "left").withColumn("svd", F.coalesce("svd", zero))


@query("i13_pca")
def i13(spark, sf):
    e = V.table(spark, sf, "embeddings")
    cols = [f"v_{i}" for i in range(64)]
    return FA.pca(e.select("vec_id", *[F.col("embedding")[i].alias(c) for i, c in enumerate(cols)]), "vec_id", cols, 8)
