"""Sums over many columns against numpy, and boosting that stops."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from featlake.operators import oof
from featlake.operators.metrics import corr_matrix


def wide(spark, n=200, p=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p)) + 1e4
    x[:, 1] = 7.0
    x[rng.random((n, p)) < 0.05] = np.nan
    df = spark.createDataFrame([(i % 3 if i % 10 else None, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "fold int, a array<double>").repartition(3)
    return x, df.select("fold", *[F.col("a")[i].alias(f"c{i}") for i in range(p)])


def test_correlation_of_300_columns(spark):
    x, df = wide(spark)
    got = {(r.a, r.b): r["corr"] for r in corr_matrix(df, [f"c{i}" for i in range(300)]).collect()}
    assert len(got) == 300 * 301 // 2
    assert got["c1", "c2"] is None and got["c1", "c1"] is None
    for i, j in [(0, 0), (0, 2), (5, 250), (298, 299)]:
        ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-9)


def test_sums_of_300_columns(spark):
    x, df = wide(spark, 60)
    x = np.where(np.isnan(x), 1.0, x)
    df = df.fillna(1.0, [f"c{i}" for i in range(300)])
    cols = [f"c{i}" for i in range(299)]
    for r in oof.gram_sums(df, cols, "c299", "fold").collect():
        mine = x[[i for i in range(60) if (i % 3 if i % 10 else None) == r["fold"]]]
        assert r["n"] == len(mine) and np.allclose(r["s"], mine.sum(axis=0)) and np.allclose(r["g"], (mine.T @ mine)[np.triu_indices(300)])
    holes = df.withColumn("c0", F.lit(None).cast("double"))
    assert oof.gram_sums(holes, cols, "c299", "fold").count() == 0


def test_boosting_stops_by_the_left_out_fold(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, 2))
    y = np.sin(5 * x[:, 0]) / 3 + 0.5 + 0.02 * rng.standard_normal(300)
    rows = spark.createDataFrame([(i, i % 3 if i % 10 else None, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, fold int, a double, b double, label double")
    v = oof.assemble_features(rows, ["a", "b"], ["id", "fold", "label"])
    got = {r["id"]: r for r in oof.boosted_oof(v, "fold", most=25, depth=3).collect()}
    kept = {r["fold"]: r["rounds"] for r in got.values() if r["fold"] is not None}
    assert len(got) == 300 and set(kept) == {0, 1, 2} and all(1 <= k <= 25 for k in kept.values())
    assert {r["rounds"] for r in got.values() if r["fold"] is None} == {sum(kept.values())}
    est = GBTRegressor(maxIter=25, maxDepth=3, seed=1, validationIndicatorCol="_valid", validationTol=0.001)
    model = est.fit(v.where("fold is not null").withColumn("_valid", F.col("fold") == 0))
    assert model.getNumTrees == kept[0]
    for r in model.transform(v.where("fold = 0")).collect():
        assert got[r["id"]]["oof"] == pytest.approx(min(1, max(0, r["prediction"])))
    assert np.mean([(got[i]["oof"] - y[i]) ** 2 for i in range(300)]) < 0.5 * y.var()
