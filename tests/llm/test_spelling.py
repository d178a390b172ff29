"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.llm import spelling


def plain_words(rows):
    total = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    n = plain_words(rows)
    near = {w: [x for x in n if edit_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def sample(seed, size=60, alphabet="abcdeé"):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(4, 8))) for _ in range(25)]
    def word():
        w = rnd.choice(stems)
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + w[i + 1:], w[:i] + rnd.choice(alphabet) + w[i:], w[:i] + rnd.choice(alphabet) + w[i + 1:]]) or "a"
        return rnd.choice([w, w.capitalize()])
    return [(i if i % 7 else None, " ".join(word() for _ in range(rnd.randint(0, 80)))) for i in range(size)]


@pytest.mark.parametrize("parts,tile", [(4, 2048), (4, 5), (3, 2048), (5, 20)])
def test_against_all_pairs(spark, parts, tile):
    rows = sample(parts) + [(3, None), (4, ""), (5, "12 !? zz"), (5, "Àçcéñt àççént àççént Àççént àççént àççént àççénts àççénts àççénts×× ÷x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = found(spelling.variants(docs, parts=parts, tile=tile))
    assert got == plain(rows) and len(got) > 20


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert found(spelling.variants(none)) == set()
    rows = sample(9, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("key", F.lit(2)).withColumn("n", F.lit(3)).withColumn("tile", F.lit(0))
    assert found(spelling.variants(docs)) == plain(rows)


def test_long_text_is_cut_between_runs(monkeypatch):
    text = "Ünïcode runs of létters, and " * 50 + "x" * 500 + " end"
    monkeypatch.setattr(spelling, "PIECE", 37)
    assert [r for p in spelling.pieces_of(text) for r in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


def test_very_long_words(spark):
    base = "ab" * 30_000
    rows = [(1, f"{base} {base}x {base[:-1]}c ") for _ in range(4)]
    n = plain_words(rows)
    got = {r[0]: r[4] for r in found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {w: sum(edit_one(w, x) for x in n) for w in n}


def test_chain_of_forms(spark):
    rows = [(1, "wordaaa " * 3 + "wordaab " * 6 + "wordabb " * 12 + "wordbbb " * 24)]
    got = {w: root for w, _, root, *_ in found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert set(got.values()) == {"wordbbb"} and len(got) == 4


def test_distances_are_exact_for_large_counts():
    w = spelling.Spelled(["a" * 5000, "a" * 4999 + "b", "a" * 4998 + "bc"])
    i, j = spelling.close_pairs(w, np.arange(3), np.arange(3))
    assert {(a, b) for a, b in zip(i, j) if a < b} == {(0, 1), (1, 2)}
