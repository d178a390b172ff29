import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlake.functions import numeric as N
from featlake.operators import columns as C
from featlake.operators import profiles as P
from featlake.operators import sampling as G
from featlake.operators.snap import nearest_values, snap_and_mix, snap_nearest
from featlake.operators import blend as B
from featlake.operators import metrics as M
from featlake.sources import files as S

INF = float("inf")
NAN = float("nan")


def test_numeric_edges(spark):
    df = spark.createDataFrame([(INF,), (-INF,), (0.0,), (None,), (-5.0,)], "x double")
    x = F.col("x")
    assert [r[0] for r in df.select(N.replace_inf(x, 9.0, -9.0)).collect()] == [9.0, -9.0, 0.0, None, -5.0]
    assert [r[0] for r in df.select(N.clip(x, 0.0, 1.0)).collect()] == [1.0, 0.0, 0.0, None, 0.0]
    assert [r[0] for r in df.where("x <= 0").select(N.log_shift(x, 0.0)).collect()] == [None, None, None]
    assert [r[0] for r in df.select(N.ratio(F.lit(1), x, -1.0)).collect()] == [0.0, 0.0, -1.0, -1.0, -0.2]


@pytest.mark.parametrize("price,cluster,parity", [(None, 8, 0), (0.0, 1, 1), (25.0, 1, -1), (499.0, 1, -1), (500.0, 2, 1),
                                                  (1000.0, 3, 1), (1250.0, 3, -1), (99999.0, 6, -1), (100000.0, 7, 1), (5e6, 7, 1)])
def test_price_clusters(spark, price, cluster, parity):
    df = spark.createDataFrame([(price,)], "p double")
    r = df.select(N.price_cluster(F.col("p")).alias("c"), N.price_parity(F.col("p")).alias("b"), *N.price_parity_onehot(F.col("p"))).first()
    assert (r.c, r.b) == (cluster, parity)
    assert [r[f"price_bin_feature_{i}"] for i in range(1, 9)] == [parity if i == cluster else 0 for i in range(1, 9)]


def test_half_even_buckets(spark):
    df = spark.createDataFrame([(50.0,), (150.0,), (250.0,)], "x double")
    assert [r[0] for r in df.select(N.round_bucket(F.col("x"), 100.0)).collect()] == [0, 2, 2]


def test_null_handling(spark, rows):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, NAN, "b"), (3, None, None)], "i int, x double, s string")
    assert C.columns_with_null(df) == ["x", "s"]
    assert C.drop_null_columns(df).columns == ["i"]
    assert [r.n_null for r in C.null_flags(df, ["x", "s"]).orderBy("i").collect()] == [0, 1, 2]
    top = spark.createDataFrame([(1, 4), (2, None)], "i int, c int")
    assert rows(C.fill_max_plus_one(top, "c")) == [(1, 4), (2, 5)]
    assert rows(C.downcast(spark.createDataFrame([(1, 300), (2, 7)], "i int, c int"), {"c": "byte"})) == [(1, None), (2, 7)]
    z = C.standardise(spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0), (3, None, 5.0)], "i int, x double, c double"), ["x", "c"], mask_null=True)
    assert rows(z) == [(1, -1.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 0.0)]
    back = C.unscale(C.scale_target(df.fillna({"x": 2.0}), "x", "t"), "t", df.fillna({"x": 2.0}), "x", "b")
    assert all(abs(r.b - r.x) < 1e-9 for r in back.collect())


def test_keyword_flags(spark):
    df = spark.createDataFrame([("почти новый, бесплатная доставка",), ("Новый",), (None,)], "t string")
    got = C.keyword_flags(df, "t").collect()
    assert [r["is_in_desc_новый"] for r in got] == [1, 0, 0] and [r["is_in_desc_есплатная_доставка"] for r in got] == [1, 0, 0]


def test_selecting_by_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a_labelencod int, oof_b int, c int")
    assert C.prune_pattern(df, ["_labelencod", "oof_"]).columns == ["c"]
    assert C.prune_listed(df, ["c", "absent"]).columns == ["a_labelencod", "oof_b"]
    assert C.column_difference(df, ["c"]) == ["a_labelencod", "oof_b"]


def test_folds_depend_on_the_key_alone(spark, rows):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    a = rows(G.assign_fold(df, "k", 5))
    assert a == rows(G.assign_fold(df.repartition(7), "k", 5))
    sizes = [sum(1 for _, f in a if f == i) for i in range(5)]
    assert sum(sizes) == 1000 and min(sizes) > 140
    kept, out = G.holdout(df, "k", 0.1)
    assert kept.count() + out.count() == 1000 and 50 < out.count() < 150
    assert rows(G.sample_n(df, "k", 5, "s")) == rows(G.sample_n(df.repartition(9), "k", 5, "s"))


def test_weekdays_on_shelf(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, DATE'2024-01-01', DATE'2024-01-01'), (2, DATE'2024-01-06', DATE'2024-01-08'),
                      (3, DATE'2024-01-03', DATE'2024-01-11'), (4, DATE'2024-01-03', DATE'2024-01-02') AS t(i, date_from, date_to)""")
    got = {r.i: [r[f"on_{d}"] for d in P.WEEKDAYS] for r in P.weekday_on_shelf(df).collect()}
    assert got == {1: [1, 0, 0, 0, 0, 0, 0], 2: [1, 0, 0, 0, 0, 1, 1], 3: [1] * 7, 4: [0] * 7}


def test_single_row_group_has_no_deviation(spark):
    df = spark.sql("SELECT 'a' AS k, 'u' AS u, 5.0D AS v, DATE'2024-01-01' AS d UNION ALL SELECT NULL, 'u', 1.0D, DATE'2024-01-02'")
    r = P.category_profile(df, "k", "u", "v", "d").collect()
    assert len(r) == 1 and r[0].v_std is None and r[0].v_median == 5.0 and r[0].average_period == 0.0
    assert {x.k for x in P.category_profile(df, "k", "u", "v", "d", null_token="NAN").collect()} == {"a", "NAN"}


def test_histogram_keeps_the_right_end(spark, rows):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.5,), (None,)], "x double")
    assert rows(P.histogram(df, "x", 0.0, 1.0, 2)) == [(0, 1), (1, 2)]


def test_nearest_is_exact_and_smaller_on_ties(spark):
    pts = [-3.0, 0.0, 0.15, 0.2, 0.24999, 0.5, 0.9, 1e6]
    refs = [0.0, 0.1, 0.2, 0.8, -2.0]
    p = spark.createDataFrame([(x,) for x in pts], "x double")
    v = spark.createDataFrame([(x,) for x in refs], "v double")
    got = {r.x: r.nearest for r in nearest_values(p, v, "x", "v").collect()}
    assert got == {x: min(refs, key=lambda t: (abs(x - t), t)) for x in pts}


def test_snapping_falls_back_to_the_raw_value(spark, rows):
    df = spark.createDataFrame([(1, "a", 0.4), (2, "b", 0.4), (3, None, 0.4), (4, "a", None)], "i int, g string, p double")
    refs = spark.createDataFrame([("a", 0.5), ("c", 0.4), (None, 0.4)], "g string, t double")
    assert rows(snap_nearest(df, "p", refs, "t", ["g"]).select("i", "snapped")) == [
        (1, 0.5), (2, 0.4), (3, 0.4), (4, None)]
    assert rows(snap_and_mix(df, "p", refs, "t", ["g"], 0.5).select("i", "final"))[0] == (1, 0.45)
    out = snap_nearest(df, "p", refs, "t", ["g"])
    assert out.columns == ["i", "g", "p", "snapped"]
    odd = spark.createDataFrame([(1, "a", float("nan"))], "i int, g string, p double")
    assert math.isnan(snap_nearest(odd, "p", refs, "t", ["g"]).first().snapped)


def test_snapping_is_exact(spark):
    refs = sorted({round(i * 0.37 % 1.3 - 0.2, 4) for i in range(60)} | {0.5, 0.50001, 0.50002})
    pts = [round(i * 0.0171 - 0.5, 4) for i in range(120)] + [0.500005, 0.500015, 40.0]
    df = spark.createDataFrame([(i, i % 2, p) for i, p in enumerate(pts)], "i int, g int, p double")
    ref = spark.createDataFrame([(g, v) for g in (0, 1) for v in refs[g::2]], "g int, t double")
    got = {r.i: r.snapped for r in snap_nearest(df, "p", ref, "t", ["g"]).collect()}
    assert got == {i: min(refs[i % 2::2], key=lambda t: (abs(p - t), t)) for i, p in enumerate(pts)}
    flat = {r.i: r.snapped for r in snap_nearest(df, "p", ref, "t").collect()}
    assert flat == {i: min(refs, key=lambda t: (abs(p - t), t)) for i, p in enumerate(pts)}


def test_blends(spark, rows):
    a = spark.createDataFrame([(1, 0.2), (2, 0.0), (3, 1.4)], "i int, p double")
    b = spark.createDataFrame([(1, 0.8), (2, 0.5), (3, 0.6)], "i int, p double")
    preds = {"a": a, "b": b}
    assert rows(B.stack_matrix(preds, "i", "p")) == [(1, 0.2, 0.8), (2, 0.0, 0.5), (3, 1.0, 0.6)]
    assert rows(B.blend_mean(preds, "i", "p"))[:2] == [(1, 0.5), (2, 0.25)]
    geo = dict(rows(B.blend_geometric(preds, "i", "p")))
    assert geo[1] == pytest.approx(0.4) and geo[2] == 0.0
    df = spark.createDataFrame([(1, 1.0, 5.0, 3.0, None)], "i int, a double, b double, c double, d double")
    r = B.row_stats(df, ["a", "b", "c", "d"]).first()
    assert (r.row_max, r.row_min, r.row_median, r.row_max_median) == (5.0, 1.0, 3.0, 2.0)


def test_metrics(spark, rows):
    df = spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.1), (0, 1, 0.5), (0, 0, 0.5), (1, 1, 0.5)], "f int, y int, p double")
    auc = dict(rows(M.auc_by(df, "y", "p", ["f"])))
    assert auc[0] == pytest.approx(0.875) and auc[1] is None
    r = {x.f: (x.rmse, x.mean_rmse) for x in M.rmse_by_fold(df, "y", "p", "f").collect()}
    assert r[1][0] == pytest.approx(0.5) and r[0][1] == pytest.approx((r[0][0] + r[1][0]) / 2)


def test_files(spark, rows, tmp_path):
    p = tmp_path / "ads.csv"
    p.write_text("i,d,x\n1,2017-03-01,1.5\n2,,NaN\n")
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("d", T.DateType()), T.StructField("x", T.DoubleType())])
    got = rows(S.read_ads(spark, str(p), schema))
    assert got[0][2] == 1.5 and got[1] == (2, None, None)
    (tmp_path / "vec.txt").write_text("2 3\ncat 1 2 3\ndog 4 5 6\n")
    assert rows(S.read_word_vectors(spark, str(tmp_path / "vec.txt"), 3)) == [("cat", [1.0, 2.0, 3.0]), ("dog", [4.0, 5.0, 6.0])]
    (tmp_path / "stop.txt").write_text("foo \n\nи\n")
    words = {r.word for r in S.load_stopwords(spark, str(tmp_path / "stop.txt"), "russian").collect()}
    assert {"foo", "и"} <= words and "" not in words
    assert S.choose_blocks(["fe_b", "fe_a_old", "fe_a", "x"], "fe_*", ["_old"]) == ["fe_a", "fe_b"]
    with pytest.raises(ValueError):
        S.write_block(spark.range(1), str(tmp_path / "b"), "key")


def test_distinct_values_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 10)
    rows = [(None if i % 50 == 0 else i % 7, i % 3, None if i % 5 == 0 else str(i % 4)) for i in range(400)]
    out = P.user_diversity(spark.createDataFrame(rows, "u int, a int, b string"), "u", ["a", "b"])
    assert out.rdd.getNumPartitions() >= 39  # a task holds about ten rows however many there are
    assert {r.u: (r.a_nunique, r.b_nunique) for r in out.collect()} == {u: (len({a for v, a, _ in rows if v == u}), len({b for v, _, b in rows if v == u})) for u in range(7)}


def test_listings_join_the_dimensions_of_orders_first(spark, tmp_path):
    """Rows without an order, orders without a customer, and a customer that comes twice give what joins one after the other give."""
    from featlake.sources import views as V
    t = {"lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date", [(1, 1, 1, 1, None), (2, 1, 1, 1, None), (3, 1, 1, 1, None), (None, 1, 1, 1, None)]),
         "orders": ("o_orderkey long, o_custkey long", [(1, 10), (2, 11), (None, 10)]), "customer": ("c_custkey long, c_mktsegment string", [(10, "x"), (10, "y"), (None, "z")])}
    for name, (schema, rows) in t.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    df = V.ads(spark, str(tmp_path), "user_id", "user_type")
    assert sorted(((r.user_id, r.user_type) for r in df.collect()), key=str) == sorted([(10, "x"), (10, "y"), (11, None), (None, None), (None, None)], key=str)
    outer, inner = (x.splitlines()[0] for x in df._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1:])
    assert "l_orderkey" in outer and "c_custkey" in inner
