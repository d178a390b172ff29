"""Embedding groups against all pairs."""

import math

import numpy as np
import pytest

from featlake.llm import embeddings
from featlake.llm.queries import LLM_QUERIES


def brute(rows, least=0.93):
    def fit(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = [set() for _ in rows]
    for a in range(n):
        for b in range(a):
            (_, v, la), (_, w, lb) = rows[a], rows[b]
            if fit(v, la) and fit(w, lb) and la == lb and len(v) == len(w):
                v, w = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                v, w = v / abs(v).max(), w / abs(w).max()
                if v @ w / math.sqrt((v @ v) * (w @ w)) >= least:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        least_id = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[a][0], len(links[a]), least_id, rows[a][0] is not None and rows[a][0] == least_id))
    return sorted(out, key=str)


def vectors(seed, n, dims=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 3, dims))
    out = [(i, (base[r.integers(len(base))] + .12 * r.normal(size=dims)).tolist(), int(r.integers(3))) for i in range(n)]
    hub = r.normal(size=dims)
    out += [(1000 + i, (hub + .05 * r.normal(size=dims)).tolist(), 1) for i in range(80)]  # one large group
    out += [(2000 + i, out[5][1], out[5][2]) for i in range(4)]                              # exact copies
    one = [1.0] + [0.0] * (dims - 1)
    out += [(3000, None, 1), (3001, [0.0] * dims, 1), (3002, one, None), (3003, one, 1), (3004, [2.0] + one[1:], 1), (3005, [float("nan")] + one[1:], 1),
            (3006, [None] + one[1:], 1), (3007, [float("inf")] + one[1:], 1), (3008, [], 1), (3009, [1.0], 1), (3010, [3e38] + one[1:], 1), (3011, one, 2), (3011, one, 2), (None, one, 2), (None, [-1.0] + one[1:], 2)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, la, 1, "a") for i, v, la in rows], "vec_id long, embedding array<float>, label int, node int, x string").repartition(4)


def test_registered(spark, tmp_path):
    rows = vectors(1, 240)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = LLM_QUERIES["op8_embedding_dedup"](spark, str(tmp_path))
    assert got.columns[:4] == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == brute(rows)


def test_many_cells_and_blocks(spark, monkeypatch):
    """Shards of 40 vectors: several splits, and dense groups that go on in blocks."""
    for name, value in (("SHARD", 40), ("SALT", 64), ("PIVOTS", 8)):
        monkeypatch.setattr(embeddings, name, value)
    rows = vectors(2, 300)
    got = sorted((tuple(r)[:4] for r in embeddings.near_duplicates(frame(spark, rows)).collect()), key=str)
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)


def test_search_recall():
    """Random vectors with near copies: the graph leads to the copies from the medoids alone."""
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 64))
    x[750:] = x[:750] + .1 * r.normal(size=(750, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = embeddings.searched(x, x, embeddings.built(x), 0.93, np.arange(1500))
    assert len(a) == 2 * 750
    a, b = embeddings.searched(x[:300] + 1e-4, x, embeddings.built(x), 0.93, None)
    assert len(a) >= 0.95 * 600


@pytest.mark.parametrize("rows", [[], [(7, None, None)]])
def test_small_tables(spark, rows):
    assert [tuple(r)[:4] for r in embeddings.near_duplicates(frame(spark, rows)).collect()] == [(i, 0, i, True) for i, _, _ in rows]


def test_a_dense_group_beside_pairs(spark):
    """A group of 1 500 near copies lies over many cells; its links are counted whole. Pairs of cosine 0.94 are found one by one."""
    r = np.random.default_rng(8)
    x = r.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = r.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    y = 0.94 * x + np.sqrt(1 - 0.94**2) * away
    hub = r.normal(size=64)
    hub /= np.linalg.norm(hub)
    group = hub + 0.02 * r.normal(size=(1500, 64))
    rows = np.concatenate([x, y, group])
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int").repartition(8)
    got = embeddings.near_duplicates(df).orderBy("vec_id").collect()
    n = np.array([g.n_links for g in got])
    assert (n[4000:] == want[4000:]).all() and {g.component_id for g in got[4000:]} == {4000}
    assert (n <= want).all() and (n[:4000] == want[:4000]).mean() >= 0.95
    assert got[0].audit_recall > 0.98 and got[0].audit_recall_vectors > 0.95


def test_pairs_hang_together():
    a, b = embeddings.hung(np.array([5, 9, 3, 20]), np.array([9, 7, 4, 21]))
    assert dict(zip(a.tolist(), b.tolist())) == {7: 5, 9: 5, 4: 3, 21: 20}
