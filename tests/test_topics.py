"""Topics against numpy after the same rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.operators import topics


def test_digamma():
    assert topics.digamma(np.array([1.0, 0.5, 10.0, 0.01])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525891, -100.5608854578], abs=1e-9)


def plain(x, start, rounds, a, e):
    g, lam = np.full((x.shape[0], start.shape[0]), a + 1.0), start.copy()
    for _ in range(rounds):
        r = np.exp(topics.digamma(g) - topics.digamma(g.sum(axis=1, keepdims=True)))
        t = np.exp(topics.digamma(lam) - topics.digamma(lam.sum(axis=1, keepdims=True)))
        w = x / (r @ t)
        g, lam = a + r * (w @ t.T), e + t * (r.T @ w)
    return g / g.sum(axis=1, keepdims=True)


def test_rounds(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(1.0, (20, 15)) * (rng.random((20, 15)) < 0.5)
    x[:, 0] += 1
    cells = spark.createDataFrame([(f"r{i:02d}", f"c{j:02d}", int(x[i, j])) for i in range(20) for j in range(15)], "a string, b string, n long").repartition(3)
    names = spark.createDataFrame([(f"c{j:02d}",) for j in range(15)], "b string")
    start = np.array([r[1:] for r in names.select("b", *[topics._first(F.col("b"), i, 1) for i in range(3)]).orderBy("b").collect()]).T
    got = topics.topic_shares(cells, "a", "b", "n", 3, iters=4, tol=0.0).orderBy("a").collect()
    assert np.allclose([r[1:] for r in got], plain(x.astype(float), start, 4, 1 / 3, 1 / 3), atol=1e-9)


def test_two_kinds_of_rows_are_parted(spark):
    rows = [(f"r{i}", f"{'xy'[i % 2]}{j}", 5) for i in range(10) for j in range(6)]
    got = {r.a: r.share0 for r in topics.topic_shares(spark.createDataFrame(rows, "a string, b string, n int"), "a", "b", "n", 2, iters=30).collect()}
    assert len({round(got[f"r{i}"]) for i in (0, 2, 4, 6, 8)}) == 1 and round(got["r0"]) != round(got["r1"])
    assert topics.topic_shares(spark.createDataFrame([], "a string, b string, n int"), "a", "b", "n", 2, iters=2).count() == 0
