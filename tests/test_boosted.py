"""Boosted trees from cells against Spark ML on the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from featlake.operators import boosted as B
from featlake.operators import oof as O


def sample(spark, n=900, seed=0):
    rng = np.random.default_rng(seed)
    x = np.hstack([rng.standard_normal((n, 2)), rng.integers(0, 6, (n, 1))])
    y = np.sin(2 * x[:, 0]) + 0.4 * x[:, 1] * (x[:, 2] > 2) + 0.3 * rng.standard_normal(n)
    rows = [(i, None if i % 11 == 0 else i % 3, float(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "i int, fold int, label double, a double, b double, c double").repartition(3)
    return O.assemble_features(df, ["a", "b", "c"], ["i", "fold", "label"])


def by_spark(est, v, col):
    out = {}
    models = {f: est.fit(v.where(F.col("fold").isNotNull() & (F.col("fold") != f))) for f in (0, 1, 2)}
    for f, m in models.items():
        for r in m.transform(v.where(F.col("fold").isNull() | (F.col("fold") == f))).collect():
            out.setdefault(r.i, []).append(col(r))
    return {i: np.mean(p) for i, p in out.items()}


@pytest.mark.parametrize("most", [B.CELLS, 0])
def test_regression(spark, monkeypatch, most):
    monkeypatch.setattr(B, "CELLS", most)  # with 0 the models grow by passes over the table
    v = sample(spark)
    got = {r.i: r.oof for r in O.gbt_oof(v, "fold", trees=5, depth=4, bounds=None).collect()}
    want = by_spark(GBTRegressor(maxIter=5, maxDepth=4, seed=1), v, lambda r: r.prediction)
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("most", [B.CELLS, 0])
def test_classes(spark, monkeypatch, most):
    monkeypatch.setattr(B, "CELLS", most)
    v = sample(spark, seed=2).withColumn("label", (F.col("label") > 0.2).cast("int"))
    got = {r.i: r.oof for r in O.classify_oof(v, "fold", kind="trees", trees=4).collect()}
    want = by_spark(GBTClassifier(maxIter=4, seed=1), v, lambda r: float(r.probability[1]))
    assert got.keys() == want.keys() and np.mean([abs(got[i] - want[i]) < 1e-9 for i in want]) > 0.98  # cuts of equal gain may be told apart by rounding


def test_stopping_by_passes(spark, monkeypatch):
    v = sample(spark, 400, 5)
    got = {r.i: (round(r.oof, 9), r.rounds) for r in O.boosted_oof(v, "fold", most=12, depth=3).collect()}
    monkeypatch.setattr(B, "CELLS", 0)
    again = {r.i: (round(r.oof, 9), r.rounds) for r in O.boosted_oof(v, "fold", most=12, depth=3).collect()}
    assert len(got) == 400 and got == again


def test_seeds_grow_together(spark):
    """Three seeds are grown from one table of cells, not by a chain of jobs for each tree."""
    v = sample(spark, 500, 3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("seeds", "seeds")
    try:
        got = {r.i: r.oof for r in O.seed_average(v, "fold", [1, 2, 3], "i", trees=4, depth=3).collect()}
    finally:
        spark.sparkContext.setJobGroup("", "")
    jobs = len(tracker.getJobIdsForGroup("seeds"))
    each = [{r.i: r.oof for r in O.gbt_oof(v, "fold", trees=4, depth=3, seed=s).collect()} for s in (1, 2, 3)]
    assert got == pytest.approx({i: np.mean([e[i] for e in each]) for i in got}) and jobs < 120


def test_rows_of_equal_bins_are_one_cell(spark):
    v = sample(spark, 60)
    many = v.unionByName(v).unionByName(v)
    points = B.split_points(GBTRegressor(seed=1), v.where("fold is not null"))
    rows = lambda d: d.where("fold is not null").select(B.vector_to_array("features").alias("x"), F.col("label").alias("y"), "fold")
    one, three = (B.cells(rows(d), [points], [0], False, False) for d in (v, many))
    assert one.count() == three.count() and three.agg(F.sum("n")).first()[0] == 3 * one.agg(F.sum("n")).first()[0]
