"""Cases that the test tables do not hold: missing targets and folds, large offsets, odd files and repeated items."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlake.functions.numeric import clip
from featlake.functions.text import split_scripts
from featlake.operators.encoders import count_encode, target_encode_oof
from featlake.operators.factors import svd_embed
from featlake.operators.oof import assemble_features, oof_predict, ridge_oof
from featlake.operators.profiles import histogram, row_histogram, user_periods
from featlake.sources.files import read_ads, read_predictions


@pytest.mark.parametrize("stat,want", [("mean", 2.0), ("median", 2.0), ("std", math.sqrt(2))])
def test_row_alone_in_its_fold_sees_the_others(spark, stat, want):
    df = spark.createDataFrame([("k", 0, 1.0), ("k", 0, 3.0), ("k", 1, None)], "k string, fold int, y double")
    got = {(r.fold, r.y): r.encoded for r in target_encode_oof(df, "k", "y", "fold", stat).collect()}
    assert got[1, None] == pytest.approx(want) and got[0, 1.0] is None


def test_spread_of_large_values(spark):
    values = [1e8 + .01 * i for i in range(50)]
    df = spark.createDataFrame([("k", i % 5, v) for i, v in enumerate(values)], "k string, fold int, y double")
    got = {r.fold: r.encoded for r in target_encode_oof(df, "k", "y", "fold", "std").select("fold", "encoded").distinct().collect()}
    assert got == pytest.approx({f: np.std([v for i, v in enumerate(values) if i % 5 != f], ddof=1) for f in range(5)}, rel=1e-6)


def test_rows_without_fold_are_predicted(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 3, float(i), 0.01 * i) for i in range(60)], "i int, fold int, x double, label double")
    out = oof_predict(LinearRegression(), assemble_features(df, ["x"], ["i", "fold", "label"]), "fold")
    assert out.count() == 60 and out.where("oof IS NULL").count() == 0
    assert ridge_oof(df, ["x"], "label", "fold").where("prediction IS NULL").count() == 0


def test_quoted_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,price\n"say ""hi"", now",1.5\n"two\nlines",2\n')
    schema = T.StructType([T.StructField("title", T.StringType()), T.StructField("price", T.DoubleType())])
    assert [tuple(r) for r in read_ads(spark, str(tmp_path), schema, multiline=True).collect()] == [('say "hi", now', 1.5), ("two\nlines", 2.0)]
    (tmp_path / "a.csv").write_text("title,price\nx,not a number\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        read_ads(spark, str(tmp_path), schema).collect()


def test_prediction_files_by_name(spark, tmp_path):
    for name in ("a.b", "axb"):
        (tmp_path / f"{name}.csv").write_text("id,p\n1,0.5\n")
    with pytest.raises(Exception, match="no model name"):
        read_predictions(spark, str(tmp_path), "id", "p", ["a.b"]).collect()
    assert read_predictions(spark, f"{tmp_path}/a.b.csv", "id", "p", ["a.b"]).first()["a.b"] == 0.5


def test_clip_keeps_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (5.0,), (None,)], "x double")
    a, b, c = (r[0] for r in df.select(clip(F.col("x"), 0.0, 1.0)).collect())
    assert math.isnan(a) and b == 1.0 and c is None


def test_scripts_are_parted_on_both_sides(spark):
    df = spark.createDataFrame([("aЖb Ж c",)], "t string")
    assert df.select(split_scripts(F.col("t"))).first()[0] == "a Ж b  Ж  c"


def test_repeated_items_have_one_owner(spark):
    periods = spark.createDataFrame([(1, "2020-01-01", "2020-01-03")], "item_id int, date_from string, date_to string")
    items = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c")], "item_id int, user_id string").repartition(3)
    got = {r.user_id: r.avg_days_up_user for r in user_periods(periods, items).collect()}
    assert got == {"a": 2.0, "b": None, "c": None}


def test_histograms_keep_empty_bins(spark):
    df = spark.createDataFrame([(1, [0.0, 0.1, 1.0, 7.0]), (2, []), (3, None), (1, [0.6])], "i int, v array<double>")
    got = sorted((r.i, r.histogram) for r in row_histogram(df, "i", "v", 0.0, 1.0, 4).collect())
    assert got == [(1, [0, 0, 1, 0]), (1, [2, 0, 0, 1]), (2, [0] * 4), (3, [0] * 4)]
    one = df.select(F.explode("v").alias("x"))
    assert sorted(tuple(r) for r in histogram(one, "x", 0.0, 1.0, 4).collect()) == [(0, 2), (1, 0), (2, 1), (3, 1)]


def test_singular_values(spark):
    r = np.random.default_rng(1)
    m = r.normal(size=(30, 8)) @ np.diag([9, 7, 5, 3, 2, 1, .5, .1])
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(30) for j in range(8)], "r int, c int, v double")
    got = np.array([x.svd for x in svd_embed(cells, "r", "c", "v", 3).collect()])
    assert np.sqrt((got**2).sum(axis=0)) == pytest.approx(np.linalg.svd(m)[1][:3], rel=1e-3)


def test_small_dictionary_stays_a_broadcast(spark):
    """A key of few values is joined without a shuffle of the rows beside one of many values."""
    df = spark.range(200_000).select((F.col("id") % 5).alias("small"), F.concat(F.lit("user with a long name "), "id").alias("large"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        plan = count_encode(df, ["small", "large"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1


def test_release_deletes_what_was_settled(spark, tmp_path, monkeypatch):
    import os

    from featlake import session
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    assert session.settle(spark.range(5)).count() == 5
    assert any(f.endswith(".parquet") for _, _, fs in os.walk(tmp_path) for f in fs)
    session.release(spark)
    assert not any(f.endswith(".parquet") for _, _, fs in os.walk(tmp_path) for f in fs)


def test_disk_path_on_a_cluster(spark, monkeypatch, tmp_path):
    from featlake import session

    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert session.settle(spark.range(5)).count() == 5
    assert session.scratch_path(spark, "x").startswith(session.shared_folder(spark))
    monkeypatch.setattr(session, "_SEEN", set())
    monkeypatch.setattr(session, "_is_shared", lambda spark, folder: False)
    with pytest.raises(RuntimeError, match="not all machines share"):
        session.shared_folder(spark)


def test_folder_that_only_one_machine_sees(spark, monkeypatch):
    from featlake import session

    named, house = spark.conf.get("spark.checkpoint.dir"), spark.conf.get("spark.sql.warehouse.dir")
    for master in ("spark://host:7077", "local-cluster[3,4,10240]"):
        monkeypatch.setattr(spark.sparkContext, "master", master)
        monkeypatch.setattr(session, "_SEEN", set())
        monkeypatch.setattr(session, "_LOST", set())
        monkeypatch.setattr(session, "_is_shared", lambda spark, folder: folder.startswith(house))
        assert not session.shared_folder(spark).startswith(named) and session.shared_folder(spark) == f"{house}/featlake"


def test_rows_of_one_file_are_dealt_over_the_cores(spark):
    from featlake import session

    one = session.settle(spark.range(100_000).coalesce(1))
    assert session.busy(one) == 1 and session.dealt(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.dealt(one, 200_000).rdd.getNumPartitions() == one.rdd.getNumPartitions() and session.dealt(one).count() == 100_000
    session.drop(one)
    with pytest.raises(Exception):
        one.count()


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    """A table in one partition leaves cores free, so no fold waits for another's fit."""
    import threading

    meet, fit = threading.Barrier(3, timeout=60), LinearRegression.fit
    monkeypatch.setattr(LinearRegression, "fit", lambda self, *a: (meet.wait(), fit(self, *a))[1])
    df = spark.createDataFrame([(i, i % 3, float(i), 0.01 * i) for i in range(60)], "i int, fold int, x double, label double").coalesce(1)
    assert oof_predict(LinearRegression(), assemble_features(df, ["x"], ["i", "fold", "label"]), "fold").count() == 60


def test_category_trees_keep_counts_of_values(spark, monkeypatch):
    """What a level writes grows with the combinations of values, not with the rows."""
    from featlake.operators import cattrees

    made, settle = [], cattrees.settle
    monkeypatch.setattr(cattrees, "settle", lambda df: (made.append(settle(df)), made[-1])[1])
    seen, drop = [], cattrees.drop
    monkeypatch.setattr(cattrees, "drop", lambda df: (seen.append(df.count()), drop(df))[1])
    df = spark.createDataFrame([(i, i % 3, float(i % 2 + i % 5 == 3), "ab"[i % 2], "xyz"[i % 5 % 3]) for i in range(600)], "i int, fold int, y double, k1 string, k2 string")
    got = cattrees.category_tree_oof(df, "i", ["k1", "k2"], "y", "fold", depth=2)
    assert got.where("prediction is null").count() == 0 and got.count() == 600 and max(seen) <= 6 * 3 * 3


def test_predictions_meet_in_one_shuffle(spark, tmp_path):
    for m, v in (("a", [0.25, None]), ("b", [0.5, 0.75])):
        spark.createDataFrame([("1", v[0]), ("2", v[1])], "id string, p double").write.option("header", True).option("compression", "gzip").csv(str(tmp_path / m))
    df = read_predictions(spark, f"{tmp_path}/*", "id", "p", ["a", "b", "c"])
    assert sorted(tuple(r) for r in df.collect()) == [("1", 0.25, 0.5, None), ("2", None, 0.75, None)]
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_terms_are_hashed_once(spark):
    from featlake.operators.vectorize import drop_rare, hash_vectors

    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a")], "doc int, text string")
    kept = drop_rare(hash_vectors(docs, "doc", "text", 64), 1)
    assert kept.count() == 3 and "md5" not in kept._jdf.queryExecution().analyzed().toString()
