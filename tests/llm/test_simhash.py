"""SimHash groups against brute force over all pairs."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from featlake.llm import simhash
from featlake.llm.common import components
from featlake.llm.queries import LLM_QUERIES


def plain(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(rows):
    """Smallest known id reachable from each row."""
    fps = list({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in rows), key=str)


def texts():
    r = random.Random(1)
    base = ["w" + str(r.randint(0, 400)) for _ in range(600)]
    out = [(3, None), (4, ""), (5, " \n"), (6, "One"), (7, "one"), (8, "one two"), (None, "one two"), (None, "alone here now"), (9, "É é \x1c x"), (9, "other words of nine")]
    for i in range(60):
        t = list(base)
        for _ in range(i % 4):
            t[r.randrange(len(t))] = "Changed"
        out.append((100 + i, r.choice([" ", "\t", "\n\n"]).join(t)))
    out += [(300 + i, " ".join(str(r.random()) for _ in range(r.randint(1, 700)))) for i in range(30)]
    return out


def test_registered(spark, tmp_path):
    rows = texts()
    (spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, lang string, fp long, component_id long")
     .repartition(5).write.parquet(f"{tmp_path}/documents.parquet"))
    got = LLM_QUERIES["op2_simhash"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = grouped([(i, plain(t)) for i, t in rows])
    assert sorted((tuple(x) for x in got.collect()), key=str) == want
    assert len({c for _, _, c in want}) < 60


def test_chunks_of_bits():
    """Long texts need several eight-bit counters for each bit."""
    r = random.Random(2)
    long = [" ".join(str(r.randint(0, 9)) for _ in range(n)) for n in (254, 255, 256, 257, 258, 5000, 1, 2, 3)]
    assert simhash.fingerprints_of([t.encode() for t in long], 3).tolist() == [plain(t) for t in long]


def test_links_and_chains(spark):
    """A chain of steps of two bits is one group, from which a gap of three bits keeps apart."""
    chain = [0]
    for i in range(20):
        chain.append(chain[-1] ^ (3 << 2 * i))
    fps = chain + [chain[-1] ^ (7 << 60)]
    df = spark.createDataFrame([(i, f if f < 1 << 63 else f - (1 << 64)) for i, f in enumerate(fps)], "id long, fp long")
    found = {r.a: r.b for r in simhash.links(df).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in found.items())
    assert components(simhash.links(df)).select("component").distinct().count() == 1
    assert components(simhash.links(df)).count() == 21


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(empty.union(spark.createDataFrame([(1, None)], empty.schema))).where(F.col("component_id") == 1).count() == 1


def test_a_batch_is_cut_by_its_bytes(spark, monkeypatch):
    """No more than CHUNK bytes and one text are hashed together."""
    sizes = []
    monkeypatch.setattr(simhash, "CHUNK", 100)
    made = simhash.fingerprints_of

    def seen(texts, words):
        sizes.append(sum(map(len, texts[:-1])))
        return made(texts, words)
    monkeypatch.setattr(simhash, "fingerprints_of", seen)
    df = spark.createDataFrame([(i, "some words of text " * (i % 4)) for i in range(60)], "doc_id long, text string")
    read = df.select("doc_id", F.col("text").cast("binary")).toArrow().to_batches()
    run = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema, **k: run.setdefault("fn", fn))
    simhash.fingerprints(df)
    got = [b for b in run["fn"](iter(read))]
    assert sum(b.num_rows for b in got) == 60 and max(sizes) <= 100 and len(sizes) > 5
