"""Pipeline stages against brute force on the same rows, and their columns."""

import random

import sentencepiece

import corpus_pipeline as pipeline
from featlake.llm.pieces import MODEL
from test_decontaminate import brute as leaks
from test_repeats import brute as repeats
from test_simhash import grouped, plain

COLUMNS = pipeline.COLUMNS


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 5, "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3)


def texts(seed):
    r = random.Random(seed)
    passage = " ".join("p" + str(r.random())[:6] for _ in range(60))
    out = [(1, None), (2, ""), (3, "x"), (None, "none here"), (None, passage)]
    for i in range(40):
        own = " ".join(str(r.random()) for _ in range(r.randint(1, 40)))
        out.append((10 + i, own + (" é" + passage + "é " if i % 3 == 0 else "") + own))
    return out + [(200 + i, t) for i, (_, t) in enumerate(out[8:20])] + [(300, out[10][1] + "\n"), (10, "second text of ten")]


def test_near_copies(spark):
    rows = texts(1)
    got = pipeline.drop_near_copies(spark, frame(spark, rows), "")
    assert got.columns == COLUMNS
    keep = [i for i, _ in {(i, fp) for i, fp, c in grouped([(i, plain(t)) for i, t in rows]) if i is not None and i == c}]
    assert keep.count(10) == 2  # two texts without anything in common
    assert sorted((r.doc_id for r in got.where("doc_id is not null").collect())) == sorted(keep)
    assert got.where("doc_id is null").count() == 2


def test_repeats(spark):
    rows = texts(2)
    got = pipeline.cut_repeats(spark, frame(spark, rows), "")
    assert got.columns == COLUMNS
    want = [(i, None if t is None else t if not gone else kept.decode(errors="ignore")) for (i, t), (_, n, gone, _, kept) in
            zip(rows, repeats(rows, 50, lambda t: list(t.encode()), bytes), strict=True) if gone == 0 or gone < n]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_leaks(spark, tmp_path):
    rows = texts(3)
    items = [(1, rows[8][1]), (2, "second text of ten"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.drop_contaminated(spark, frame(spark, rows), str(tmp_path))
    assert got.columns == COLUMNS
    bad = {(r[0], r[1]) for r in leaks(rows, items) if r[-1]}
    assert bad
    from test_decontaminate import words
    assert sorted((str(r.doc_id), len(words(r.text))) for r in got.collect()) == sorted((str(i), len(words(t))) for i, t in rows if (i, len(words(t))) not in bad)


def test_pieces(spark):
    rows = texts(4)
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pipeline.tokenise(spark, frame(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text, r.n_pieces) for r in got), key=str) == sorted(((i, t, None if t is None else len(own.encode(t))) for i, t in rows), key=str)


def test_whole_run(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_pieces", "ids", "text"]
    left = {r.doc_id: r.text for r in out.collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert 0.6 * len(before) < len(left) < len(before)
    assert sum(left[i] == before[i] for i in left) > 0.5 * len(left)
    toxic = [r.doc_id for r in labels.where("toxic = 1").collect()]
    assert sum(i in left for i in toxic) < 0.35 * len(toxic)


def test_empty(spark):
    sf = "/root/testdata/sf0.001"
    for _, stage in pipeline.STAGES:
        assert stage(spark, frame(spark, []), sf).count() == 0
    odd = frame(spark, [(1, None), (2, ""), (None, None), (2, "")])
    for _, stage in pipeline.STAGES:
        # texts without words are near copies of each other, so one of those with an id stays there
        assert stage(spark, odd, sf).count() == (2 if stage is pipeline.drop_near_copies else 4)
