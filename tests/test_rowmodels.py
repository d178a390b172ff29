"""Nearest neighbours and randomised trees against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.operators import extratrees, neighbours


def sample(spark, n, d, seed, levels=None, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, (n, d)).astype(float) if levels else rng.standard_normal((n, d)) * np.linspace(1, 3, d)
    if copies:
        x[rng.random(n) < copies] = x[0]
    y = x.sum(axis=1) + rng.standard_normal(n)
    fold = [None if i % 8 == 7 else i % 3 for i in range(n)]
    rows = [(f"d{i:05d}", fold[i], float(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc string, fold int, y double, " + ", ".join(f"x{i} double" for i in range(d)))
    return x, y, np.array([-1 if f is None else f for f in fold]), df.repartition(4)


def knn(x, y, fold, k):
    out = np.zeros(len(x))
    for i in range(len(x)):
        per = []
        for f in ([fold[i]] if fold[i] >= 0 else sorted(set(fold) - {-1})):
            ok = np.flatnonzero((fold >= 0) & (fold != f))
            d2 = ((x[ok] - x[i]) ** 2).sum(axis=1)
            per.append(y[ok[np.lexsort([ok, d2])][:k]].mean())
        out[i] = np.mean(per)
    return out


def values(df, col):
    return np.array([r[col] for r in df.orderBy("doc").select(col).collect()], float)


@pytest.mark.parametrize("n,d,levels,copies,k,tile,pivots", [(400, 2, None, 0, 5, 4096, 20), (500, 3, None, 0, 7, 40, 60), (600, 2, 6, 0.4, 10, 50, 12), (60, 1, None, 0, 80, 8, 5)])
def test_neighbours(spark, monkeypatch, n, d, levels, copies, k, tile, pivots):
    monkeypatch.setattr(neighbours, "TILE", tile)
    x, y, fold, df = sample(spark, n, d, n, levels, copies)
    got = values(neighbours.knn_oof(df, "doc", [f"x{i}" for i in range(d)], "y", "fold", k, pivots=pivots), "knn")
    assert np.allclose(got, knn(x, y, fold, k), atol=1e-9)


def test_neighbours_without_values(spark):
    x, y, fold, df = sample(spark, 80, 2, 1)
    hole = df.withColumn("x1", F.when(~F.col("doc").endswith("3"), F.col("x1"))).withColumn("y", F.when(~F.col("doc").endswith("4"), F.col("y")))
    lacks, blank = np.arange(80) % 10 == 3, np.arange(80) % 10 == 4
    got = values(neighbours.knn_oof(hole, "doc", ["x0", "x1"], "y", "fold", 4), "knn")
    assert np.isnan(got[lacks]).all()
    for i in np.flatnonzero(~lacks):
        per = []
        for f in ([fold[i]] if fold[i] >= 0 else [0, 1, 2]):
            ok = np.flatnonzero((fold >= 0) & (fold != f) & ~lacks & ~blank)
            d2 = ((x[ok] - x[i]) ** 2).sum(axis=1)
            per.append(y[ok[np.lexsort([ok, d2])][:4]].mean())
        assert got[i] == pytest.approx(np.mean(per))
    none = neighbours.knn_oof(df.where("fold is null"), "doc", ["x0", "x1"], "y", "fold")
    assert none.where("knn is not null").count() == 0 and none.count() == 10


def test_few_points_meet_far_cells(spark):
    """On twice the rows the searches of other cells grow about as the rows do, not as their square."""
    made = []
    search = neighbours._search
    for n in (2000, 4000):
        _, _, _, df = sample(spark, n, 2, 3)
        seen = []

        def count(queries, *rest, seen=seen):
            seen.append(queries.count())
            return search(queries, *rest)
        neighbours._search = count
        try:
            neighbours.knn_oof(df, "doc", ["x0", "x1"], "y", "fold", 5, pivots=200)
        finally:
            neighbours._search = search
        made.append(seen[1])
    assert made[1] < 2.5 * made[0]


def tree(x, y, seed, t, fold, node, depth, out, left, rows):
    out[node] = y[rows].mean() if len(rows) else 0.0
    if depth == 0 or len(rows) < 2 or np.ptp(y[rows]) == 0:
        return
    best = None
    for f in range(x.shape[1]):
        lo, hi = x[rows, f].min(), x[rows, f].max()
        cut = lo + extratrees.draw(seed, t, fold, node, f) * (hi - lo)
        a, b = rows[x[rows, f] < cut], rows[x[rows, f] >= cut]
        if len(a) and len(b):
            gain = y[a].sum() ** 2 / len(a) + y[b].sum() ** 2 / len(b)
            if best is None or gain > best[0] + 1e-12:
                best = gain, f, cut, a, b
    if best:
        left[node] = best[1:3]
        tree(x, y, seed, t, fold, 2 * node + 1, depth - 1, out, left, best[3])
        tree(x, y, seed, t, fold, 2 * node + 2, depth - 1, out, left, best[4])


def test_trees(spark):
    x, y, fold, df = sample(spark, 150, 3, 9)
    got = values(extratrees.extra_trees_oof(df, "doc", ["x0", "x1", "x2"], "y", "fold", trees=3, depth=4, bounds=None), "prediction")
    value = {}
    for t in range(3):
        for f in (0, 1, 2):
            out, split = {}, {}
            tree(x, y, 1, t, f, 0, 4, out, split, np.flatnonzero((fold >= 0) & (fold != f)))
            value[t, f] = out, split
    want = []
    for i in range(len(y)):
        per = []
        for f in ([fold[i]] if fold[i] >= 0 else [0, 1, 2]):
            for t in range(3):
                out, split = value[t, f]
                node = 0
                while node in split:
                    node = 2 * node + 1 + int(x[i, split[node][0]] >= split[node][1])
                per.append(out[node])
        want.append(np.mean(per))
    assert np.allclose(got, want, atol=1e-9)


def test_trees_without_targets(spark):
    _, _, _, df = sample(spark, 30, 2, 2)
    none = extratrees.extra_trees_oof(df.withColumn("y", F.lit(None).cast("double")), "doc", ["x0"], "y", "fold", trees=2)
    assert none.where("prediction is not null").count() == 0 and none.count() == 30
    flat = extratrees.extra_trees_oof(df.withColumn("y", F.lit(0.5)).withColumn("x0", F.lit(None).cast("double")), "doc", ["x0", "x1"], "y", "fold", trees=2, depth=3)
    assert {r.prediction for r in flat.collect()} == {0.5}


def test_models_are_parted_over_tasks(spark, monkeypatch):
    """Rows in one partition are read by a task for each group of models, with the same sums."""
    _, _, _, df = sample(spark, 200, 2, 4)
    made, passed = [], extratrees._passed
    monkeypatch.setattr(extratrees, "_passed", lambda rows, fn, groups, *a: (made.append(groups), passed(rows, fn, groups, *a))[1])
    got = values(extratrees.extra_trees_oof(df.coalesce(1), "doc", ["x0", "x1"], "y", "fold", trees=4, depth=3), "prediction")
    monkeypatch.setattr(extratrees, "busy", lambda rows: 1000)
    monkeypatch.setattr(extratrees, "_passed", lambda rows, fn, groups, *a: (made.append(groups), passed(rows, fn, 1, *a))[1])
    assert (values(extratrees.extra_trees_oof(df.coalesce(1), "doc", ["x0", "x1"], "y", "fold", trees=4, depth=3), "prediction") == got).all()
    assert set(made[:7]) == {4} and set(made[7:]) == {1} and len(made) == 14  # two passes a level, one for the last
