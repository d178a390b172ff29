"""Near copies against the shares of common shingles of all pairs."""

import random
import re

import pytest

import corpus_pipeline as pipeline
from featlake.llm import nearcopies
from test_pipeline import frame


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [(i, least.get(find(n))) for n, (i, _) in enumerate(rows)]


def texts():
    r = random.Random(4)
    out = [(900, None), (901, " \n"), (902, "two words"), (903, "Two  words"), (904, "two words more"), (None, "only here")]
    for g in range(12):
        base = [f"g{g}w{r.randint(0, 300)}" for _ in range(r.choice([30, 100, 400]))]
        for i in range(8):
            t = list(base)
            for _ in range(int(len(t) * r.choice([0, .01, .02, .08]))):
                t[r.randrange(len(t))] = "Changed" + str(r.random())
            out.append((r.randrange(10_000) * 10 + g % 10 if i else None, "\n".join(t)))
    return out


@pytest.mark.parametrize("leaders", [4, 0])
def test_pairs_of_four_fifths(spark, monkeypatch, leaders):
    """Also when all pairs of a band are compared at once."""
    monkeypatch.setattr(nearcopies, "LEADERS", leaders)
    rows = texts()
    got = [tuple(x) for x in nearcopies.near_copies(frame(spark, rows)).select("doc_id", "component_id").collect()]
    assert sorted(got, key=str) == sorted(components(rows), key=str)


def test_stage_removes_edited_copies(spark):
    """One word in a hundred differs: similarity above 0.8, but more than two bits of a fingerprint."""
    words = [f"w{i}" for i in range(300)]
    edited = [f"other{i}" if i % 100 == 50 else w for i, w in enumerate(words)]
    distant = [f"third{i}" if i % 10 == 5 else w for i, w in enumerate(words)]
    got = pipeline.drop_near_copies(spark, frame(spark, [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(distant))]), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_copies_do_not_stay_for_their_id(spark):
    """Of two rows with id 5 one copies document 3; the other one stays, and a null text stays null."""
    got = pipeline.drop_near_copies(spark, frame(spark, [(3, "a text of three"), (5, "a text of three"), (5, "b of five alone"), (7, None)]), "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(3, "a text of three"), (5, "b of five alone"), (7, None)]


def test_rows_of_one_id_are_different_documents(spark):
    got = pipeline.drop_near_copies(spark, frame(spark, [(10, "one text about apples and pears today"), (10, "another text, wholly unlike the first"), (10, "one text about apples and pears today")]), "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(10, "another text, wholly unlike the first"), (10, "one text about apples and pears today")]


def chain(size, seed=1, words=104):
    """Each text is a copy of an earlier one with two words changed."""
    r = random.Random(seed)
    out = [[f"w{i}" for i in range(words)]]
    while len(out) < size:
        t = list(r.choice(out))
        for _ in range(2):
            t[r.randrange(words)] = f"c{len(out)}x{r.randrange(10**6)}"
        out.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_chain_of_edits_is_one_component(spark):
    got = nearcopies.near_copies(frame(spark, chain(800)))
    assert {r.component_id for r in got.collect()} == {0}


def test_a_large_group_that_is_not_near(spark):
    """Half of the group's texts have so many words of their own that no two are near; the others are near the base."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            t[r.randrange(len(t))] = f"own{i}x{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = [tuple(x) for x in nearcopies.near_copies(frame(spark, rows)).select("doc_id", "component_id").collect()]
    assert sorted(got) == sorted(components(rows))


def test_stage_links_by_simhash(spark, monkeypatch):
    """Without bands and prefixes the fingerprints alone find copies that differ in order or in a word of many."""
    words = [f"w{i}" for i in range(3000)]
    edited = words[:2999] + ["other"]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(f"x{i}" for i in range(50)))]
    monkeypatch.setattr(nearcopies, "_with_least", lambda keys: keys.select(keys.node.alias("a"), keys.node.alias("b")).where("a <> b"))
    monkeypatch.setattr(nearcopies, "_apart", lambda keys, roots: keys.where("false"))
    got = pipeline.drop_near_copies(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_described_in_small_parts():
    """A batch of 3 MB of text is described with less than 50 MB."""
    import tracemalloc

    import pyarrow as pa
    from featlake.llm import nearcopies

    texts = [" ".join(f"w{(i * 7919 + j * j) % 5003}" for j in range(350)).encode() for i in range(1500)]
    ids = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.binary()), ids], ["id", "text", "hash"])
    assert sum(map(len, texts)) > 2.5e6
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in nearcopies.described(iter([batch]), 5)) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()


def test_marks_part_what_is_not_near(spark):
    """Of 100 texts of one base none is near another: their rare keys meet, but no pair is handed on; two near ones are."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:240] + [f"own{i}x{j}" for j in range(60)])) for i in range(100)]
    rows += [(200, rows[0][1] + " more"), (201, rows[0][1] + " less")]
    sets = spark.createDataFrame([(i, s) for i, s in enumerate(nearcopies.pack(nearcopies.np.diff(nearcopies.np.unique(x >> nearcopies.U64(32)), prepend=nearcopies.U64(0)).astype("uint32"))
                                  for x in nearcopies.shingle_sets([t.encode() for _, t in rows], 5))], "node long, shingles binary")
    keys = nearcopies.prefixes(sets, 0.8).withColumn("root", nearcopies.F.col("node"))
    marks = sets.mapInArrow(nearcopies._marks, "node long, " + ", ".join(f"m{i} long" for i in range(nearcopies.MARKS // 64)))
    keys = keys.unionByName(keys.withColumn("key", nearcopies.F.lit(1)).withColumn("place", nearcopies.F.lit(0).cast("long")).dropDuplicates(["node"]))  # all meet in one key
    pairs = {tuple(r) for r in nearcopies._with_all(keys, marks, 0.8).collect()}
    assert pairs == {(100, 0), (101, 0), (101, 100)}


def test_bands_hold_only_what_meets(spark, monkeypatch):
    """Keys that one node has are not written again, and copies are compared only with the others of their keys."""
    seen = []
    real = nearcopies._with_least
    monkeypatch.setattr(nearcopies, "_with_least", lambda keys: seen.append(keys) or real(keys))
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(f"x{i}y{j}" for j in range(50))) for i in range(50)] + [(90, " ".join(words)), (91, " ".join(words[:99] + ["other"]))]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(frame(spark, rows)).collect()}
    assert got == {i: 90 if i == 91 else i for i, _ in rows}
    assert seen[0].count() <= 2 * nearcopies.BANDS


def test_texts_are_shuffled_once(spark):
    rows = [(i, f"text of {i} alone and {i * i}") for i in range(50)]
    plan = pipeline.drop_near_copies(spark, frame(spark, rows).localCheckpoint(), "")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert text.count("Exchange hashpartitioning") == 2
