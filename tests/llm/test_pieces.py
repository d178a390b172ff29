"""Encoding against the model's own encoder, and the round trip."""

import random

import numpy as np
import pytest
import sentencepiece

from featlake.llm import pieces
from featlake.llm.queries import LLM_QUERIES

BITS = ["a", "e", "th", "  ", "   ", " ", "\n", "\t", "é", "你", "𝒳", "the ", "\xa0", "ing", "un", "1", "22", "==", "----", "　", "。", "\x00"]


@pytest.fixture(scope="module")
def own():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def random_text(r, n):
    return "".join(r.choice(BITS) for _ in range(r.randint(0, n)))


def test_words(own):
    p, r = pieces.Model()(), random.Random(1)
    for _ in range(4000):
        t = random_text(r, 25)
        ids = np.frombuffer(p.run(pieces.escaped(t)), "<i4")
        assert ids.tolist() == own.encode(t) and p.decoded(ids) == t


def rows_of(spark, texts, chunk):
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string, row string").repartition(3)
    out = pieces.decode(pieces.encode(df, chunk=chunk))
    assert out.columns == ["row", "text", "ids", "decoded"] and out.select("row.*").columns == ["doc_id", "ids", "row"]
    return {r.row.doc_id: (r.text, r["ids"], r.decoded) for r in out.collect()}


@pytest.mark.parametrize("chunk", [20, 37])
def test_chunks(spark, own, chunk):
    """Chunks shorter than words, so that most boundaries lie inside a word."""
    r = random.Random(chunk)
    texts = [None, "", " ", "x"] + [random_text(r, 120) for _ in range(40)]
    texts += ["".join(r.choice("abcdefgh=-1") for _ in range(n)) for n in (19, 20, 21, 40, 41, 200, 333)] + ["the " * 50, "-" * 100, "thethe" * 40]
    got = rows_of(spark, texts, chunk)
    for i, t in enumerate(texts):
        want = None if t is None else own.encode(t)
        assert got[i] == (t, None if t is None else np.array(want, "<i4").tobytes(), t), (i, t)


def test_matrices_combine(own):
    """The state after two chunks is the same from one matrix or from the product of two."""
    p, r = pieces.Model()(), random.Random(4)
    text = pieces.BLANK + "".join(r.choice("theingaou") for _ in range(60))
    mid, end = p.states(text, 20), p.states(text, 40)
    first, second = p.transfer(text, 0, 20, [(0, 0)], mid)[0], p.transfer(text, 20, 40, mid, end)[0]
    whole = p.transfer(text, 0, 40, [(0, 0)], end)[0]
    assert (pieces.times(first, second) == whole).all() and (whole > pieces.NONE).any()


def test_registered(spark, tmp_path, own):
    texts = [(1, None), (2, ""), (None, "a b"), (4, "▁x  y"), (4, "▁x  y"), (5, "the word " * 4000)]
    spark.createDataFrame([(i, t, "e") for i, t in texts], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_chars): (r.n_pieces, r.round_trip) for r in LLM_QUERIES["op7_sentencepiece"](spark, str(tmp_path)).collect()}
    assert got == {(i, None if t is None else len(t)): ((None, True) if t is None else (len(own.encode(t)), True)) for i, t in texts}


def test_empty_table(spark):
    assert pieces.decode(pieces.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
