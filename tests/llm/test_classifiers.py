"""Toxicity chain and quality discriminant: held-out accuracy, the folds, and odd tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.llm import quality, toxicity
from featlake.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.1"


def test_quality_held_out(spark):
    got = LLM_QUERIES["op5_quality"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= .5) for r in rows)
    unseen = [r for r in rows if r.held_out and r.quality is not None]
    for y in (0, 1):
        mine = [r for r in unseen if r.quality == y]
        assert sum(r.predicted == y for r in mine) / len(mine) > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    wrong = labels.withColumn("quality", F.when(quality.remainder(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality(docs, x).collect()} for x in (labels, wrong))
    assert a == pytest.approx(b)


def test_discriminant_against_plain_formula():
    """Scores equal the log density difference from explicit inverses and determinants."""
    r = np.random.default_rng(1)
    x = r.normal(size=(50, 3))
    cov = [np.array([[2, .3, 0], [.3, 1, 0], [0, 0, .5]]), np.eye(3)]
    means, priors = [np.zeros(3), np.ones(3)], [.3, .7]
    model = quality.Discriminant(.7, np.zeros(3), np.ones(3), tuple(priors), tuple(means), tuple(np.linalg.inv(np.linalg.cholesky(c)) for c in cov))
    log = [np.log(p) - .5 * np.log(np.linalg.det(c)) - .5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) for p, m, c in zip(priors, means, cov, strict=True)]
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(log[0] - log[1])))


def test_toxicity_against_labels(spark):
    got = LLM_QUERIES["op4_toxicity"](spark, SF)
    assert got.columns == ["doc_id", "p_insult", "p_contempt", "p_toxic", "toxic"]
    rows = got.withColumnRenamed("toxic", "found").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert sum(r.found for r in rows if r.toxic == 1) / sum(r.toxic for r in rows) > 0.85
    assert sum(r.found for r in rows if r.toxic == 0) < 0.005 * len(rows)


def test_toxicity_unlabelled(spark):
    """Labels of one half find the toxic documents of the other."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    taught = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    rows = (toxicity.toxicity(docs.select("doc_id", "text"), taught).select("row.doc_id", F.col("toxic").alias("found"))
            .join(labels, "doc_id").join(taught.select("doc_id"), "doc_id", "left_anti").collect())
    assert sum(r.found for r in rows if r.toxic == 1) / sum(r.toxic for r in rows) > 0.8
    assert sum(r.found for r in rows if r.toxic == 0) < 0.01 * len(rows)


def test_later_models_see_unseen_probabilities():
    """The second category is the first one's probability, learned from rows that its models had not seen."""
    r = np.random.default_rng(2)
    rows = [sorted(set(r.integers(0, 6, 3).tolist())) for _ in range(600)]
    first = np.array([0 in x for x in rows], int)
    chain = toxicity.fit_chain(rows, np.column_stack([first, first]), np.arange(600) % 3, {f"t{i}": i for i in range(6)})
    assert len(chain.weights[0]) == 7 and len(chain.weights[1]) == 8 and chain.weights[1][6] > 0
    assert ((chain.score(rows)[:, 1] > .5) == first).all()


def odd(spark):
    docs = [(1, None), (1, None), (2, ""), (None, "idiot"), (3, "word " * 50_000), (4, "\x00퟿ $$$ 123"), (5, "idiot scum"), (5, "x")]
    return (spark.createDataFrame([(i, t, 1, 0.5, "r", 1) for i, t in docs], "doc_id long, text string, toxic int, p_toxic double, row string, y int"),
            spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (5, 0, 1), (5, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int"))


def test_odd_rows(spark):
    docs, labels = odd(spark)
    for lab in (labels, labels.limit(0), labels.where("quality = 1")):
        q = quality.quality(docs, lab).collect()
        assert len(q) == 8 and all(0 <= r.score <= 1 for r in q)
        assert all(not r.held_out for r in q if r.doc_id is None)
        t = toxicity.toxicity(docs, lab).collect()
        assert len(t) == 8 and all(0 <= r[c] <= 1 for r in t for c in ("p_insult", "p_contempt", "p_toxic"))
        assert {len(r.row) for r in t} == {6}
    assert not any(r.toxic for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0 and toxicity.toxicity(docs.limit(0), labels).count() == 0
