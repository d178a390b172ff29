import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from featlake.operators import factors as FA
from featlake.operators import oof as O

RNG = np.random.default_rng(0)
N = 300
X = RNG.normal(size=(N, 3))
Y = 0.3 * X[:, 0] - 0.2 * X[:, 1] + 0.5 + RNG.normal(scale=0.05, size=N)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, i % 5, float(Y[i]), *map(float, X[i])) for i in range(N)], "i int, fold int, y double, a double, b double, c double")


def _ridge(x, y, alpha):
    mx, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return w, my - mx @ w


def test_ridge_from_sums_equals_the_direct_solution(spark, df):
    test = spark.createDataFrame([(1000, 0.1, -0.2, 0.3)], "i int, a double, b double, c double")
    got = {r.i: r.prediction for r in O.ridge_oof(df, ["a", "b", "c"], "y", "fold", 2.0, test=test, bounds=None).collect()}
    fold = np.arange(N) % 5
    models = [_ridge(X[fold != f], Y[fold != f], 2.0) for f in range(5)]
    for i in range(0, N, 17):
        w, b = models[i % 5]
        assert got[i] == pytest.approx(X[i] @ w + b, abs=1e-9)
    assert got[1000] == pytest.approx(np.mean([np.array([0.1, -0.2, 0.3]) @ w + b for w, b in models]), abs=1e-9)


def test_own_fold_is_never_seen(df):
    moved = df.withColumn("y", F.when(F.col("i") == 7, F.lit(50.0)).otherwise(F.col("y")))
    a = {r.i: r.prediction for r in O.ridge_oof(df, ["a", "b"], "y", "fold", 1.0, bounds=None).collect()}
    b = {r.i: r.prediction for r in O.ridge_oof(moved, ["a", "b"], "y", "fold", 1.0, bounds=None).collect()}
    assert all(a[i] == pytest.approx(b[i]) for i in range(2, N, 5))
    assert any(abs(a[i] - b[i]) > 1e-3 for i in range(3, N, 5))


@pytest.mark.parametrize("fit", [lambda t, s: O.linear_oof(t, "fold", s, reg=0.0), lambda t, s: O.gbt_oof(t, "fold", s, trees=3, depth=3),
                                 lambda t, s: O.forest_oof(t, "fold", s, trees=5, depth=4), lambda t, s: O.fm_oof(t, "fold", s, iters=10)])
def test_oof_models_cover_all_rows_in_range(df, fit):
    rows = df.withColumnRenamed("y", "label")
    vec = O.assemble_features(rows, ["a", "b", "c"], ["i", "fold", "label"])
    out = fit(vec.where("i >= 50"), vec.where("i < 50").drop("fold", "label")).select("i", "oof").collect()
    assert sorted(r.i for r in out) == list(range(N)) and all(0.0 <= r.oof <= 1.0 for r in out)


def test_linear_oof_beats_the_mean(df):
    vec = O.assemble_features(df.withColumnRenamed("y", "label"), ["a", "b", "c"], ["i", "fold", "label"])
    got = {r.i: r.oof for r in O.oof_predict(LinearRegression(), vec, "fold", bounds=None).collect()}
    err = np.sqrt(np.mean([(got[i] - Y[i]) ** 2 for i in range(N)]))
    assert err < 0.5 * Y.std()


def test_predict_missing(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 7), None if i % 4 == 0 else float(np.exp(1 + 0.2 * (i % 7)))) for i in range(60)],
                               "i int, fold int, x double, price double")
    out = {r.i: r for r in O.predict_missing(df, ["x"], "price", "fold", 1e-6, "p").collect()}
    assert len(out) == 60
    assert all(r.p_diff == 0.0 for i, r in out.items() if i % 4 == 0)
    assert all(r.p == pytest.approx(np.exp(1 + 0.2 * (i % 7)), rel=1e-3) for i, r in out.items())


def _cells(m, spark):
    return spark.createDataFrame([(f"r{i}", f"c{j}", float(v)) for (i, j), v in np.ndenumerate(m) if v > 0], "r string, c string, v double")


def test_nmf_rebuilds_a_low_rank_table(spark):
    w, h = RNG.random((12, 2)), RNG.random((2, 7))
    m = w @ h
    m[m < 0.1] = 0
    rows = {r.r: np.array(r.nmf) for r in FA.nmf(_cells(m, spark), "r", "c", "v", 2, iters=12).collect()}
    assert len(rows) == 12 and all((v >= 0).all() for v in rows.values())
    got = np.array([rows[f"r{i}"] for i in range(12)])
    best = got @ np.linalg.lstsq(got, m, rcond=None)[0]
    assert np.linalg.norm(best - m) < 0.25 * np.linalg.norm(m)


def test_nmf_groups_do_not_mix(spark):
    m = RNG.random((6, 5))
    one = _cells(m, spark)
    two = one.withColumn("g", F.lit("x")).unionByName(one.withColumn("r", F.concat(F.lit("z"), "r")).withColumn("v", F.col("v") * 3).withColumn("g", F.lit("y")))
    alone = {r.r: r.nmf for r in FA.nmf(one, "r", "c", "v", 2, iters=3).collect()}
    both = {r.r: r.nmf for r in FA.nmf(two, "r", "c", "v", 2, iters=3, by="g").collect() if r.g == "x"}
    for k, v in alone.items():
        assert both[k] == pytest.approx(v)


@pytest.mark.parametrize("shape", [(9, 6), (5, 8)])
def test_nmf_packed_equals_joins(spark, monkeypatch, shape):
    """Rounds without joins of cells give the same factors, whichever side is the smaller one."""
    m = RNG.random(shape)
    m[m < 0.3] = 0
    cells = _cells(m, spark).withColumn("g", F.lit("x")).unionByName(_cells(m.T @ m, spark).withColumn("g", F.lit("y")))
    made, step = [], FA._nmf_step
    monkeypatch.setattr(FA, "_nmf_step", lambda *a: (made.append(1), step(*a))[1])
    got = {(r.g, r.r): r.nmf for r in FA.nmf(cells, "r", "c", "v", 2, iters=4, by="g").collect()}
    assert not made
    monkeypatch.setattr(FA, "DENSE", 0)
    want = {(r.g, r.r): r.nmf for r in FA.nmf(cells, "r", "c", "v", 2, iters=4, by="g").collect()}
    assert made and got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], rel=1e-9) for x in want)


def test_svd_matches_numpy(spark):
    m = np.abs(RNG.normal(size=(15, 9)))
    rows = {r.r: r.svd for r in FA.svd_embed(_cells(m, spark), "r", "c", "v", 3, iters=12).collect()}
    got = np.array([rows[f"r{i}"] for i in range(15)])
    s = np.linalg.svd(m)[1][:3]
    assert np.linalg.norm(got, axis=0) == pytest.approx(s, rel=1e-2)


def test_topics_sum_to_one(spark):
    df = spark.createDataFrame([(f"u{i % 9}", f"c{i * i % 5}") for i in range(90)], "a string, b string")
    for r in FA.lda_embed(df, "a", "b", 3, iters=3).collect():
        assert r.lda_1 + r.lda_2 + r.lda_3 == pytest.approx(1.0)


def test_pca_is_white(spark):
    df = spark.createDataFrame([(i, *map(float, X[i])) for i in range(N)], "i int, a double, b double, c double")
    p = FA.pca(df, "i", ["a", "b", "c"], 2)
    r = p.agg(F.stddev_samp("pca_1").alias("s"), F.corr("pca_1", "pca_2").alias("c")).first()
    assert r.s == pytest.approx(1.0) and r.c == pytest.approx(0.0, abs=1e-9)


def test_halves_predict_each_other(df):
    out = O.half_oof(df, "i", ["a", "b"], "y", 1.0).select("i", "prediction").collect()
    w, b = _ridge(X[150:, :2], Y[150:], 1.0)
    got = {r.i: r.prediction for r in out}
    assert got[3] == pytest.approx(float(np.clip(X[3, :2] @ w + b, 0, 1)), abs=1e-9) and len(got) == N
