"""Metric and blend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.operators import blend as B
from featlake.operators import metrics as M
from featlake.plans.registry import query, round_doubles
from featlake.sources import views as V

_MODELS = [f"model_{m}" for m in range(1, 6)]
_P = V.preds_sql()


@query("d27_rmse_by_fold", f"""
WITH {_P}, r AS (SELECT fold, sqrt(avg((target - model_3) ** 2)) AS rmse FROM preds GROUP BY 1)
SELECT fold, round(rmse, 6) AS rmse, round((SELECT avg(rmse) FROM r), 6) AS mean_rmse FROM r""")
def d27(spark, sf):
    return round_doubles(M.rmse_by_fold(V.preds(spark, sf), "target", "model_3", "fold"))


@query("d28_rmsle", f"""
WITH {_P} SELECT round(sqrt(avg((ln(1 + target) - ln(1 + greatest(model_3, 0))) ** 2)), 6) AS rmsle FROM preds""")
def d28(spark, sf):
    return round_doubles(M.rmsle(V.preds(spark, sf), "target", "model_3"))


@query("d29_auc", f"""
WITH {_P}, y AS (SELECT fold, CAST(target >= 0.55 AS INT) AS y, model_5 AS p FROM preds),
r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0::DOUBLE AS rk FROM y),
s AS (SELECT fold, sum(y) AS pos, count(*) - sum(y) AS neg, sum(rk) FILTER (y = 1) AS rs FROM r GROUP BY 1)
SELECT fold, round((rs - pos * (pos + 1) / 2) / (pos * neg), 6) AS auc FROM s""")
def d29(spark, sf):
    y = V.preds(spark, sf).withColumn("y", (F.col("target") >= 0.55).cast("int"))
    return round_doubles(M.auc_by(y, "y", "model_5", ["fold"]))


@query("d29_auc_documents", """
WITH y AS (SELECT lang, quality AS y, n_chars AS p FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0::DOUBLE AS rk FROM y),
s AS (SELECT lang, sum(y) AS pos, count(*) - sum(y) AS neg, sum(rk) FILTER (y = 1) AS rs FROM r GROUP BY 1)
SELECT lang, round(CASE WHEN pos * neg > 0 THEN (rs - pos * (pos + 1) / 2) / (pos * neg) END, 6) AS auc FROM s""")
def d29_docs(spark, sf):
    return round_doubles(M.auc_by(V.docs(spark, sf), "quality", "n_chars", ["lang"]))


def _corr_sql(cols, rel):
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM {rel}" for a, b in pairs)


@query("d30_corr_matrix", f"WITH {V.ADS_SQL} " + _corr_sql(["price", "item_seq_number", "image_top_1", "target"], "ads"))
def d30(spark, sf):
    cols = ["price", "item_seq_number", "image_top_1", "target"]
    return round_doubles(M.corr_matrix(V.ads(spark, sf, *cols), cols))


@query("k6_prediction_correlation", f"WITH {_P} " + _corr_sql(_MODELS, "preds"))
def k6(spark, sf):
    return round_doubles(M.corr_matrix(V.preds(spark, sf), _MODELS))


def _split(spark, sf, models=_MODELS):
    p = V.preds(spark, sf)
    return {m: p.select("item_id", F.col(m).alias("prediction")) for m in models}


@query("j11_stack_matrix", f"WITH {_P} SELECT item_id, " + ", ".join(f"least(greatest({m}, 0), 1) AS {m}" for m in _MODELS) + " FROM preds")
def j11(spark, sf):
    return B.stack_matrix(_split(spark, sf), "item_id", "prediction")


@query("k1_blend_mean", f"WITH {_P} SELECT item_id, round(({' + '.join(_MODELS)}) / 5, 6) AS blend FROM preds")
def k1(spark, sf):
    return round_doubles(B.blend_mean(_split(spark, sf), "item_id", "prediction"))


@query("k2_blend_weighted", f"WITH {_P} SELECT item_id, round(0.5 * model_1 + 0.3 * model_2 + 0.2 * model_3, 6) AS blend FROM preds")
def k2(spark, sf):
    p = V.preds(spark, sf)
    return round_doubles(B.blend_weighted(p, {"model_1": 0.5, "model_2": 0.3, "model_3": 0.2}).select("item_id", "blend"))


@query("k3_blend_geometric", f"""
WITH {_P} SELECT item_id, round(CASE WHEN least({', '.join(_MODELS)}) <= 0 THEN 0 ELSE exp(({' + '.join(f'ln(greatest({m}, 0.0001))' for m in _MODELS)}) / 5) END, 6) AS blend
FROM preds""")
def k3(spark, sf):
    return round_doubles(B.blend_geometric(_split(spark, sf), "item_id", "prediction"))


@query("k7_row_stats", f"""
WITH {_P}, s AS (SELECT item_id, list_sort([{', '.join(_MODELS[:4])}]) AS l FROM preds)
SELECT item_id, l[4] AS row_max, l[1] AS row_min, round((l[2] + l[3]) / 2, 6) AS row_median, round(l[4] - (l[2] + l[3]) / 2, 6) AS row_max_median FROM s""")
def k7(spark, sf):
    s = B.row_stats(V.preds(spark, sf), _MODELS[:4])
    return round_doubles(s.select("item_id", "row_max", "row_min", "row_median", "row_max_median"))
