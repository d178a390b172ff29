import math
import statistics

import pytest
from pyspark.sql import functions as F

from featlake.operators import encoders as E
from featlake.operators import ranks as R

DATA = [(i, ["a", "b", "c", None][i % 4], float(i * 7 % 10) / 10, i % 3) for i in range(40)] + [(40, "once", 0.3, 1)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(DATA, "i int, k string, y double, fold int")


@pytest.mark.parametrize("stat,fn", [("mean", statistics.mean), ("median", statistics.median), ("std", statistics.stdev)])
def test_fold_safe_encoding_uses_other_folds_only(df, stat, fn):
    got = {r.i: r.encoded for r in E.target_encode_oof(df, "k", "y", "fold", stat).collect()}
    assert len(got) == len(DATA)
    for i, k, _, f in DATA:
        ys = [y for _, kk, y, ff in DATA if kk == k and ff != f]
        if k is None or not ys:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(fn(ys))


def test_own_target_does_not_move_own_code(spark, df):
    moved = df.withColumn("y", F.when(F.col("i") == 4, F.lit(99.0)).otherwise(F.col("y")))
    for stat in ("mean", "median"):
        a = {r.i: r.encoded for r in E.target_encode_oof(df, "k", "y", "fold", stat).collect()}
        b = {r.i: r.encoded for r in E.target_encode_oof(moved, "k", "y", "fold", stat).collect()}
        assert a[4] == pytest.approx(b[4])


def test_unseen_and_null_categories(spark, rows, df):
    test = spark.createDataFrame([(100, "a"), (101, "new"), (102, None)], "i int, k string")
    enc = dict(rows(E.target_encode(test, "k", "y", "mean", train=df).select("i", "encoded")))
    assert enc[100] is not None and enc[101] is None and enc[102] is None
    smooth = dict(rows(E.target_encode_smooth(test, "k", "y", 2.0, 5.0, train=df).select("i", "encoded")))
    prior = statistics.mean(y for _, _, y, _ in DATA)
    assert smooth[101] == pytest.approx(prior) and smooth[102] == pytest.approx(prior)
    ys = [y for _, k, y, _ in DATA if k == "a"]
    s = 1 / (1 + math.exp(-(len(ys) - 5) / 2))
    assert smooth[100] == pytest.approx(prior * (1 - s) + statistics.mean(ys) * s)
    noisy = E.target_encode_smooth(test, "k", "y", 2.0, 5.0, train=df, noise=0.1, seed=3)
    assert rows(noisy.select("i", "encoded")) == rows(noisy.select("i", "encoded"))


def test_mode_ties_go_to_the_smaller_value(spark, rows):
    df = spark.createDataFrame([("g", 5), ("g", 5), ("g", 2), ("g", 2), ("g", None), ("h", None)], "g string, v int")
    assert rows(E.group_mode(df, "g", "v")) == [("g", 2)]
    out = [r.v for r in E.impute_group(df, "v", "g", "mode").orderBy("g", "v").collect()]
    assert sorted(v for v in out if v is not None) == [2, 2, 2, 5, 5] and out.count(None) == 1


def test_count_encode_learns_on_train_rows(spark, rows):
    df = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, "y", 1), (4, None, 1)], "i int, a string, b int")
    out = E.count_encode(df, ["a", "b"], train=df.where("i < 4"))
    assert rows(out.select("i", "count_a", "count_b")) == [(1, 2, 3), (2, 2, 3), (3, 1, 3), (4, None, 3)]


def test_label_codes_share_train_and_test(spark, rows):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "i int, c string")
    assert rows(R.label_encode(df, ["c"])) == [(1, 1), (2, 2), (3, 0), (4, 1)]


def test_dedupe_and_vocab(spark, rows):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), ("m", 1, None)], "k string, o int, v string")
    assert rows(R.dedupe_first(df, ["k"], ["o"])) == [("k", 1, "early"), ("m", 1, None)]
    toks = spark.createDataFrame([(t,) for t in "b b a a c".split()], "t string")
    assert [(r.t, r.id) for r in R.build_vocab(toks, "t", 2).orderBy("id").collect()] == [("a", 1), ("b", 2)]


def test_erfinv_matches_the_library_and_gauss_rank_is_monotone(spark):
    xs = [-0.999, -0.9, -0.85, -0.2, 0.0, 0.3, 0.85, 0.86, 0.999]
    got = [r.e for r in spark.createDataFrame([(x,) for x in xs], "x double").select(F.expr(R.erfinv_sql("x")).alias("e")).collect()]
    for x, e in zip(xs, got):
        assert e == pytest.approx(statistics.NormalDist().inv_cdf((x + 1) / 2) / math.sqrt(2), abs=1e-12)
    df = spark.createDataFrame([(i, float(i * 37 % 11)) for i in range(60)], "i int, v double")
    out = [r.s for r in R.gauss_rank(df, "v", "i", "s").orderBy("v", "i").collect()]
    assert out == sorted(out) and len(set(out)) == 60 and out[0] == pytest.approx(-out[-1])
