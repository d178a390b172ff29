"""The language model: counts and base scores by brute force, probabilities and gradients by hand."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featlake.llm import maxent


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), " "]


def plain(rows):
    count = Counter(t for i, text in rows if not held_out(i) for t in tokens_of(text))
    n, v = sum(count.values()), len(count)
    out = []
    for i, text in rows:
        toks = tokens_of(text)
        out.append((i, held_out(i), len(toks), sum(count[t] > 0 for t in toks), n, round(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks), 6)))
    return out


def corpus(seed, size=150):
    rnd = random.Random(seed)
    follow = {i: [rnd.randrange(40) for _ in range(3)] for i in range(40)}
    rows = []
    for i in range(size):
        w, words = rnd.randrange(40), []
        for _ in range(rnd.randint(0, 120)):
            w = rnd.choice(follow[w]) if rnd.random() < 0.9 else rnd.randrange(40)
            words.append(f"W{w}" if rnd.random() < 0.5 else f"w{w}")
            if rnd.random() < 0.03:
                words.append(f"rare{rnd.randrange(300)}É")
        rows.append((i, rnd.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    return rows


ODD = [(None, "w1 w2 unseen"), (500, None), (501, ""), (502, " \n\t "), (503, "x" * 5000 + " w1"), (503, "w1 w2 w\u0085x"), (3, "w1 w1 w1")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def digest(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("head", [1 << 18, 30, 0])
def test_counts_and_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(maxent, "PIECE", 50)
    rows = corpus(1) + ODD
    got = maxent.score(frame(spark, rows).withColumn("row", F.lit(1)).withColumn("n", F.lit(2)), head=head, bits=12)
    assert digest(got) == sorted(plain(rows), key=repr)


def test_the_model_knows_more_than_the_base(spark):
    rows = corpus(2, 600)
    got = maxent.score(frame(spark, rows), bits=14).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.3


def test_nothing_to_learn(spark):
    assert maxent.score(frame(spark, [])).count() == 0
    only = [i for i in range(50) if held_out(i)][:2]
    got = maxent.score(frame(spark, [(i, "a b") for i in only]), bits=10).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0, 0)] * 2


def small_model(seed=0, size=70, bits=8):
    rng = np.random.default_rng(seed)
    count = np.sort(rng.zipf(1.5, size).clip(1, 5000))[::-1].astype(np.int64)
    model = maxent.Model(pa.array([b"%d" % i for i in range(size)], pa.binary()), count, int(count.sum()) + 50, size + 30, None, bits,
                         rng.normal(0, 0.5, (1 << bits, maxent.WAYS)).astype(np.float32), np.ones(1 << bits, np.float32))
    model.tree = maxent.classes(np.append(count + 0.5, model.rare_mass))
    return model


def logs(model, word, before, before2):
    s = maxent.steps(model, word, before, before2)
    return np.bincount(s.token, maxent.weighed(model, s)[2], len(word))


@pytest.mark.parametrize("size", [0, 1, 5, 70, 3000])
def test_probabilities_sum_to_one(size):
    model = small_model(size=size)
    for before in (0, size, size + 1):
        every = np.arange(size + 1)
        p = np.exp(logs(model, every, np.full(size + 1, before), np.full(size + 1, size + 1)))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_without_weights_the_base_is_left():
    model = small_model()
    model.weights[:] = 0
    mass = np.append(model.n + 0.5, model.rare_mass)
    assert mass.sum() == pytest.approx(model.tokens + 0.5 * (model.types + 1))
    got = logs(model, np.arange(71), np.zeros(71, np.int64), np.zeros(71, np.int64))
    assert np.allclose(got, np.log(mass / mass.sum()), atol=1e-4)


def test_a_step_follows_the_gradient():
    model = small_model(bits=6)
    rng = np.random.default_rng(5)
    word, before, before2 = (rng.integers(0, 70, 40) for _ in range(3))
    old = model.weights.copy()
    maxent.learn(model, word, before, before2, np.zeros(64, np.float32))
    step = (model.weights - old) * np.sqrt(model.history)[:, None] / -maxent.RATE
    for row, way in [(3, 1), (17, 0), (40, 15), (63, 7)]:
        loss = []
        for d in (-1e-2, 1e-2):
            model.weights = old.copy()
            model.weights[row, way] += d
            loss.append(-logs(model, word, before, before2).sum())
        assert step[row, way] == pytest.approx((loss[1] - loss[0]) / 2e-2, abs=2e-2)


def test_scores_by_hand(spark):
    """Each text scored class by class in plain Python, with the weights that training left."""
    rows = corpus(6, 80)
    df = frame(spark, rows)
    texts = df.where(~F.coalesce(maxent.remainder(F.col("doc_id")) == 1, F.lit(False))).select(F.col("text").cast("binary").alias("text"))
    known = maxent.counts(texts).cache()
    count = {bytes(r.token): r.n for r in known.collect()}
    model = maxent.train(texts, known, head=25, bits=10, rounds=1)
    ids = {w: i for i, w in enumerate(model.words.to_pylist())}
    assert 0 < len(ids) <= 25 and model.rare == len(ids)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([False] * len(rows)), pa.array([t.encode() for _, t in rows])], ["id", "held_out", "text"])
    out = next(iter(maxent.scored(iter([batch]), model)))
    t = model.tree
    for i in (0, 3, 11):
        want, last = 0.0, [model.rare + 1] * 2
        for token in tokens_of(rows[i][1]):
            w = ids.get(token.encode(), model.rare)
            s = maxent.steps(model, np.array([w]), np.array([last[1]]), np.array([last[0]]))
            for level, k in enumerate(range(t.start[w], t.start[w] + t.length[w])):
                n = int(t.length[w])
                spot = [s.row[level]] + ([s.row[n + level], s.row[n + s.wide + level]] if level < 2 else [])
                z = t.prior[t.node[k]].astype(float) + model.weights[spot].sum(axis=0)
                want += z[t.way[k]] - np.log(np.exp(z - z.max()).sum()) - z.max()
            last = [last[1], w]
        assert out.column(5)[i].as_py() == pytest.approx(want / math.log(10), rel=1e-4)
        assert sorted(out.column(6)[i].as_py()) == sorted(x.encode() for x in tokens_of(rows[i][1]) if x.encode() not in ids)


def test_learners_are_averaged_by_use(spark, monkeypatch):
    """Many small learners in teams: each row is the mean of its learners' weights by the times they met it."""
    monkeypatch.setattr(maxent, "FAN", 3)
    rng = np.random.default_rng(1)
    made = []
    for learner in range(11):
        row = np.flatnonzero(rng.random(maxent.SLICE) < 0.01)
        made.append((row, rng.integers(1, 9, len(row)).astype(np.float32), rng.random(len(row)).astype(np.float32), rng.standard_normal((len(row), maxent.WAYS)).astype(np.float32)))
    tables = [pa.table([pa.array([0], pa.int32()), pa.array([i], pa.int32()), pa.array([maxent.packed(*m)], pa.binary())], ["slice", "learner", "rows"]) for i, m in enumerate(made)]
    while len(tables) > 1:
        tables = [maxent.averaged(pa.concat_tables(tables[i:i + 3])) for i in range(0, len(tables), 3)]
    row, v = maxent.unpacked(tables[0].column("rows")[0].as_py())
    for r, got in zip(row, v):
        mine = [(m[1][m[0] == r][0], m[2][m[0] == r][0], m[3][m[0] == r][0]) for m in made if (m[0] == r).any()]
        assert got[0] == pytest.approx(sum(n for n, _, _ in mine)) and got[1] == pytest.approx(sum(h for _, h, _ in mine), rel=1e-5)
        assert np.allclose(got[2:], sum(n * w for n, _, w in mine) / sum(n for n, _, _ in mine), atol=1e-5)


def test_learners_do_not_name_rare_words():
    """Only scores need the words outside the head by name; both get the same numbers and contexts."""
    ids = {b"a": 0, b"b": 1, maxent.END: 2}
    for text in (None, b"", b"A x b", b"x y a z b y"):
        named, plain = list(maxent.coded(text, ids, 3)), list(maxent.coded(text, ids, 3, named=False))
        assert [(c.tolist(), last) for c, last, _ in named] == [(c.tolist(), last) for c, last, _ in plain]
        assert [w for _, _, some in named for w in some] == [w for w in (text or b"").lower().split() if w not in ids]
        assert all(some == [] for _, _, some in plain)
