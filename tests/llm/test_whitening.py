"""Whitening against numpy's eigenvectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.llm.whitening import eigen, polar_factor, whiten


@pytest.mark.parametrize("n,spread", [(1, 1), (2, 10), (7, 1e3), (40, 1e12), (64, 1e6), (130, 3)])
def test_eigen_of_a_matrix(n, spread):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    a = (q * np.exp(rng.random(n) * np.log(spread + 0.1))) @ q.T
    a = (a + a.T) / 2
    e, v = eigen(a, 16)
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(a))[::-1][:16], rtol=0, atol=1e-13 * e[0])
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13 and np.linalg.norm(a @ v - v * e) < 1e-12 * e[0]


def test_equal_and_zero_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((24, 24)))[0]
    a = (q * np.repeat([3.0, 1.0, 0.0], 8)) @ q.T
    e, v = eigen((a + a.T) / 2)
    assert np.allclose(e, np.repeat([3.0, 1.0, 0.0], 8), atol=1e-13) and np.linalg.norm(a @ v - v * e) < 1e-12
    assert np.allclose(eigen(np.eye(5) * 2)[0], 2)


def test_polar_factor_is_orthogonal():
    a = np.diag([5.0, 1e-9, -3.0, -1e-7])
    assert np.allclose(polar_factor(a), np.diag([1, 1, -1, -1]), atol=1e-9)


def plain(rows, k=16):
    """Rows (id, vector) by numpy."""
    d = len(rows[0][1])
    ok = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in ok], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = np.array(fit - 1_000_000, float)
    c -= c.mean(axis=0)
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    e, u = e[e > 1e-13 * np.trace(v)], u[:, e > 1e-13 * np.trace(v)]
    white = (np.array(x - 1_000_000, float) - np.array([float(t - n * 1_000_000) / n for t in s])) @ u / np.sqrt(e)
    return n, [(ok[i][0], int(sum((n * x[i] - s) ** 2))) for i in range(len(ok))], white, e / np.trace(v)


def check(df, rows, k=16):
    n, dev, white, share = plain(rows, k)
    got = whiten(df, components=k).collect()
    assert len(got) == len(dev) * len(share)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert set(by) == set(dev) and all(r.n == n for r in got)
    for i, key in enumerate(dev):
        for c in range(1, len(share) + 1):
            assert abs(by[key][c].explained / share[c - 1] - 1) < 1e-8
    sign = [np.sign(by[dev[0]][c].whitened * white[0, c - 1]) for c in range(1, len(share) + 1)]
    for i, key in enumerate(dev):
        assert np.allclose([by[key][c].whitened * sign[c - 1] for c in range(1, len(share) + 1)], white[i], atol=1e-6)
    assert all(r.identity_error < 1e-9 for r in got)


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    vecs = rng.standard_normal((300, 20)) * np.linspace(0.2, 4, 20)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(vecs)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(150)]  # a third are copies
    bad = [(900, None), (901, [None] * 20), (902, [math.nan] + [0.0] * 19), (903, [math.inf] + [0.0] * 19), (904, [1.0]), (905, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("vec", F.lit(2)).withColumn("component", F.lit(3))
    check(df.repartition(5), rows)
    check(df, rows, 3)


def test_fewer_dimensions_than_vectors_span(spark):
    rnd = random.Random(4)
    rows = [(i, [a, 2 * a, float(rnd.randint(-3, 3))]) for i, a in enumerate(float(rnd.randint(-9, 9)) for _ in range(40))]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows)


def test_nothing_to_whiten(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        out = whiten(spark.createDataFrame(rows, kind))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_deviation_of_large_entries_is_exact(spark):
    rows = [(i, [float(i) * 1e4, -float(i % 7) * 3e3]) for i in range(60)]
    n, dev, *_ = plain(rows)
    got = {(r.vec_id, r.deviation) for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == set(dev)
