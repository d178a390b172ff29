"""Benchmark windows in documents against brute force."""

import hashlib
import random
import re

import oracle
from featlake.llm import decontaminate
from featlake.llm.queries import LLM_ORACLES, LLM_QUERIES

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, who = words(t), set(), set()
        for item, x in items:
            x = words(x)
            n = min(10, len(x))
            for s in range(len(x) - n + 1 if n else 0):
                for a in range(len(w) - n + 1):
                    if w[a:a + n] == x[s:s + n]:
                        hit |= set(range(a, a + n))
                        who.add(str(item))
        out.append((i, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(seed):
    r = random.Random(seed)
    v = ["the", "of", "É", "é", "ß9", "x", "Y", "12", "long"]
    items = [(i, " ".join(r.choice(v) for _ in range(r.choice([0, 1, 2, 3, 9, 10, 11, 25])))) for i in range(14)] + [(20, None), (21, "?!"), (22, "rare\x00one"), (22, "same id again, other text of some more words here ok")]
    docs = [(1, None), (2, ""), (3, "..."), (4, "rare one"), (None, "RARE  ONE x"), (5, "the " * 40), (5, "the " * 40), (5, "zzz")]
    for i in range(40):
        parts = []
        for _ in range(4):
            w = (r.choice(items)[1] or "").split()
            parts += w[r.randint(0, 3):] if r.random() < .6 else [str(r.random()) for _ in range(6)]
        docs.append((30 + i, r.choice([" ", "-", ", "]).join(parts).upper() if i % 2 else " ".join(parts)))
    return docs, items


def test_registered(spark, tmp_path):
    docs, items = tables(1)
    spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, hash int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = LLM_QUERIES["op1_decontaminate"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.report(docs, items).collect()] == [2]
    assert [r.n_hit for r in decontaminate.report(docs, items.limit(0)).collect()] == [0]
    assert decontaminate.report(docs.limit(0), items).count() == 0


def test_many_blocks(spark, monkeypatch):
    """The answer is the same when every broadcast holds two hashes at most."""
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    docs, items = tables(2)
    rows = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc, r.n_words, r.n_hit, len(r["items"])) for r in rows.collect()), key=str) == [x[:4] for x in brute(docs, items)]


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(LLM_QUERIES["op1_decontaminate"](spark, sf), oracle.connect(sf), LLM_ORACLES["op1_decontaminate"]) is None
