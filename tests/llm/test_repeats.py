"""Exact-repeat removal against brute force."""

import hashlib
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from featlake.llm import superkmer, substring, suffixes
from featlake.llm.queries import LLM_QUERIES

SHAPE = "doc_id long, text string, lang string, kept string, row string, slice int"


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "en", "k", None, 1) for i, t in texts], SHAPE).repartition(parts)


def brute(texts, k, cut, join):
    """(id, tokens, removed, runs, kept) of each row by comparing every window with all others."""
    least = {}
    for i, t in texts:
        p = cut(t or "")
        for j in range(len(p) - k + 1):
            if i is not None:
                w = tuple(p[j:j + k])
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        p = cut(t or "")
        hit = [False] * len(p)
        for j in range(len(p) - k + 1):
            if i is not None and least[tuple(p[j:j + k])] < i:
                hit[j:j + k] = [True] * k
        runs = sum(h and (n == 0 or not hit[n - 1]) for n, h in enumerate(hit))
        out.append((i, len(p), sum(hit), runs, join(x for x, h in zip(p, hit, strict=True) if not h)))
    return out


def words(t):
    return [w for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]


def texts_of(seed, n, vocabulary=None):
    r = random.Random(seed)
    vocabulary = vocabulary or ["a", "bb", "ccc", "é", "ß,", " x", "x y", "\x1cz"]
    passages = [" ".join(r.choice(vocabulary) for _ in range(40)) for _ in range(4)]
    out = [(5, None), (6, ""), (7, "  \n\t "), (8, "a"), (None, passages[0]), (9, passages[0]), (9, passages[0]), (9, passages[1])]
    for i in range(n):
        parts = [r.choice(passages)[r.randint(0, 30):r.randint(40, 90)] if r.random() < .5 else " ".join(str(r.random()) for _ in range(r.randint(0, 12))) for _ in range(4)]
        out.append((100 + i if r.random() < .9 else 100, r.choice([" ", "\n", "  ", "\t"]).join(parts)))
    return out + [(700, "a " * 300), (701, "a " * 200), (702, "ab" * 200), (703, "ab" * 150), (704, "x" * 60), (705, "x" * 49)]


def result(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_removed, len(r.spans), bytes(r.kept or b"")) for r in df.select("row.doc_id", "n_tokens", "n_removed", "spans", "kept").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    texts = texts_of(seed, 60)
    assert result(substring.remove_repeated_words(frame(spark, texts))) == sorted(brute(texts, 13, words, b" ".join), key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes(spark, seed):
    texts = texts_of(seed, 60)
    assert result(suffixes.remove_repeated_bytes(frame(spark, texts))) == sorted(brute(texts, 50, lambda t: list(t.encode()), bytes), key=str)


@pytest.mark.parametrize("mod,k,cut,join", [(substring, 13, words, b" ".join), (suffixes, 50, lambda t: list(t.encode()), bytes)])
def test_long_texts_in_pieces(monkeypatch, mod, k, cut, join):
    """A limit of 500 bytes puts every text in many pieces."""
    monkeypatch.setattr(superkmer, "BATCH", 900)
    monkeypatch.setattr(superkmer, "CHUNK", 500)
    for seed in (5, 6):
        texts = list({i: (i, (t or "") * 3) for i, t in texts_of(seed, 30) if i is not None}.values())
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts], pa.int64()), pa.array([x.encode() for _, x in texts], pa.binary()),
                                            pa.array([{"a": 1}] * len(texts))], ["id", "text", "row"])
        monkeypatch.setattr(superkmer.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3))
        table = pa.Table.from_batches(list(superkmer.packed_batches(iter([batch]))))
        assert table.num_rows > 5
        how, hit = mod.method(), {}
        order = {b: superkmer.opened_batch(d).column("id").to_pylist() for b, d in zip(*(c.to_pylist() for c in table.columns), strict=True)}
        told = pa.Table.from_batches(list(superkmer.announce(iter(table.to_batches()), how, 7)))
        back = pa.concat_tables([superkmer.in_several(told.filter(pc.equal(told["bucket"], b))) for b in set(told["bucket"].to_pylist())])
        sent = pa.concat_tables([superkmer.ship(back.filter(pc.equal(back["batch"], b)), table.filter(pc.equal(table["batch"], b)), how, 7, True) for b in order])
        for b in set(sent["bucket"].to_pylist()):
            bucket = superkmer.opened(sent.filter(pc.equal(sent["bucket"], b)))
            for e, a, z in zip(*superkmer.covered(bucket, how), strict=True):
                hit.setdefault(order[bucket.batch[e]][bucket.place[e]], set()).update(range(a, z))
        assert {i: len(x) for i, x in hit.items()} == {i: n for i, _, n, _, _ in brute(texts, k, cut, join) if n}


@pytest.mark.parametrize("mod", [substring, suffixes])
def test_repeats_between_chunks_of_one_batch(spark, mod):
    """The first text fills a chunk of 2 MB by itself; the batch goes on with a second chunk, and no other batch holds the passages."""
    r = random.Random(12)
    pair, three = (" ".join(f"{r.getrandbits(40):x}" for _ in range(20)) for _ in range(2))
    long = " ".join(f"{r.getrandbits(60):x}" for _ in range(150_000))
    assert len(long) > superkmer.CHUNK and len(long) < superkmer.BATCH - 10_000
    texts = [(1, f"{pair}<{three}>{long}"), (2, f"2{three}?"), (3, f"3 {pair};{three}."), (4, long[-2000:-1000])]
    op = substring.remove_repeated_words if mod is substring else suffixes.remove_repeated_bytes
    got = {i: (n, runs) for i, _, n, runs, _ in result(op(frame(spark, texts, 1).coalesce(1)))}
    if mod is substring:  # the words at the border of two passages differ
        want = {i: (n, runs) for i, _, n, runs, _ in brute(texts, 13, words, b" ".join)}
        assert want[2] == (18, 1) and want[3] == (19 + 18, 2)
    else:
        want = {1: (0, 0), 2: (len(three), 1), 3: (len(pair) + len(three), 2), 4: (1000, 1)}
    assert got == want


def test_empty_and_clashing_columns(spark):
    for op in (substring.remove_repeated_words, suffixes.remove_repeated_bytes):
        empty = op(frame(spark, []))
        assert empty.count() == 0 and empty.columns == ["row", "n_tokens", "n_removed", "kept", "spans"]
        assert op(frame(spark, [(1, None), (2, "")])).select("row.*").columns == ["doc_id", "lang", "kept", "row", "slice"]


def test_hash_collisions_are_told_apart(monkeypatch):
    """With a hash that is the same for all windows, only the texts themselves decide."""
    texts = [t or "" for _, t in texts_of(8, 20)]
    for mod, k in ((substring, 13), (suffixes, 50)):
        method = mod.method()
        strings = [x for x in dict.fromkeys(t.encode() for t in texts) if len(method.parts(x)) >= k]
        tok, owners = method.tokenise(strings), np.arange(len(strings), dtype=np.int64) + 3
        want = method.smallest(tok, owners, k)
        monkeypatch.setattr(mod, "rolled", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
        assert (method.smallest(tok, owners, k) == want).all()


def test_repeat_groups(spark):
    """Every occurrence of each group is real, and groups of two documents appear with both."""
    r = random.Random(7)
    a, b = ("".join(r.choice("abcdefgh ") for _ in range(70)) for _ in range(2))
    texts = [(1, "x" + a + "y"), (2, "z" + a + "w" + b), (3, b + "q"), (4, "unrelated"), (5, a)]
    got = suffixes.repeat_groups(frame(spark, texts)).collect()
    by_id = dict(texts)
    for g in got:
        assert by_id[g.doc_id].encode()[g.start:g.start + g.length] == bytes(g.text) and g.length >= 50
    groups = {}
    for g in got:
        groups.setdefault(bytes(g.text), set()).add(g.doc_id)
    assert set(map(frozenset, groups.values())) == {frozenset({1, 2, 5}), frozenset({2, 3})}


@pytest.mark.parametrize("name,k,cut,join", [("op3_substring_dedup", 13, words, b" ".join), ("op10_suffix_dedup", 50, lambda t: list(t.encode()), bytes)])
def test_registered(spark, tmp_path, name, k, cut, join):
    texts = [(i, t) for i, t in texts_of(11, 50)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = LLM_QUERIES[name](spark, str(tmp_path))
    want = brute(texts, k, cut, join)
    rows = sorted(((r.doc_id, r[1], r.n_removed, r.kept_sha256) for r in got.collect()), key=str)
    assert rows == sorted(((i, n, g, hashlib.sha256(x).hexdigest()) for i, n, g, _, x in want), key=str)
    if "n_spans" in got.columns:
        assert sorted(r.n_spans for r in got.select(F.col("n_spans")).collect()) == sorted(s for _, _, _, s, _ in want)


def test_minimisers_in_steps(monkeypatch):
    """Windows are worked out in steps: the same super-k-mers, and less than 50 MB beside 2 MB of text."""
    import tracemalloc

    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (0, 10, 49, 50, 51, 700, 3000)]
    tok = superkmer.byte_tokens(texts)
    whole = superkmer.superkmers(tok, 50, 20)
    for step in (1, 7, 64):
        monkeypatch.setattr(superkmer, "STEP", step)
        assert all(np.array_equal(a, b) for a, b in zip(whole, superkmer.superkmers(tok, 50, 20), strict=True))
    monkeypatch.undo()
    tok = superkmer.byte_tokens([bytes(rng.integers(97, 123, 2 << 20).astype(np.uint8))])
    tracemalloc.start()
    try:
        superkmer.superkmers(tok, 50, 20)
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()
