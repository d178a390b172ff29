import statistics

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from featlake.operators.ordering import cumulative, global_index
from featlake.operators.quantiles import grouped_median, grouped_quantile, ordered_parts, prefix_sums, value_counts_by
from featlake.operators.ranks import rank_avg

slow = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.one_of(st.none(), st.just(0.0), st.floats(-1e9, 1e9, allow_nan=False).map(lambda v: round(v, 3)),
                   st.sampled_from([1.0, 1.0001, -1.0, 1e-9, 5.0]))
tables = st.lists(st.tuples(st.sampled_from(["a", "b", None]), values), min_size=1, max_size=40)


@slow
@given(tables)
def test_median_equals_the_plain_one(spark, data):
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r.median for r in grouped_median(df, ["k"], "v").collect()}
    want = {}
    for k in {k for k, v in data if k is not None and v is not None}:
        want[k] = statistics.median([v for kk, v in data if kk == k and v is not None])
    assert got.keys() == want.keys()
    for k in want:
        assert abs(got[k] - want[k]) <= 1e-9 * max(1.0, abs(want[k]))


@slow
@given(tables)
def test_rank_shares_ties_and_keeps_all_rows(spark, data):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(data)], "i int, k string, v double")
    got = {r.i: r.rank for r in rank_avg(df, "v", ["k"]).collect()}
    assert len(got) == len(data)
    full = [(k, -1.0 if v is None else v) for k, v in data]
    for i, (k, v) in enumerate(full):
        if k is None:
            assert got[i] is None
            continue
        above = sum(1 for kk, vv in full if kk == k and vv > v)
        same = sum(1 for kk, vv in full if kk == k and vv == v)
        assert got[i] == above + (same + 1) / 2


def test_close_values_of_one_group_span_partitions(spark):
    """A million seconds of one day, in one group, are sorted by several tasks."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") / 10 + 1.7e9).alias("v"))
    parts = ordered_parts(value_counts_by(df, ["k"], "v"), ["k", "v"])
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < n
    assert grouped_median(df, ["k"], "v").first().median == 1.7e9 + (n - 1) / 20


def test_quantile_skips_nan_and_null_and_weighs(spark, rows):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 3), ("a", float("nan"), 9), ("a", None, 9), ("b", None, 1)], "k string, v double, w int")
    assert rows(grouped_quantile(df, ["k"], "v", 0.5, "m", weight="w", count="n")) == [("a", 4, 3.0)]
    assert rows(grouped_quantile(df, ["k"], "v", 0.25, "q")) == [("a", 1.5)]


def test_one_hot_key_is_exact_across_partitions(spark):
    n = 40000
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
                               (F.col("id") * 7919 % n).cast("double").alias("v"))
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {r.k: r.median for r in grouped_median(df, ["k"], "v").collect()} == want


def test_prefix_sums(spark, rows):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("a", -1.0), ("a", 7.0), ("b", 0.0)], "k string, v double")
    out = prefix_sums(value_counts_by(df, ["k"], "v"), ["k"], "v")
    assert rows(out.select("k", "v", "n", "before")) == [("a", -1.0, 1, 0), ("a", 2.0, 2, 1), ("a", 7.0, 1, 3), ("b", 0.0, 1, 0)]
    down = prefix_sums(value_counts_by(df, ["k"], "v"), ["k"], "v", descending=True)
    assert rows(down.select("k", "v", "before")) == [("a", -1.0, 3), ("a", 2.0, 1), ("a", 7.0, 0), ("b", 0.0, 0)]


def test_global_index_and_running_total_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 10).cast("double").alias("y"))
    seen = []
    for parts in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        idx = global_index(df, ["x"], "i")
        assert idx.where("i <> x").count() == 0
        total = cumulative(df, "y", ["x"], "t").orderBy("x").collect()
        seen.append([r.t for r in total])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert seen[0] == seen[1] and seen[0][-1] == sum(i % 10 for i in range(5000))
