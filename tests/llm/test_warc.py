"""WARC records and the Merkle audit."""

import hashlib

import oracle
import pytest
from pyspark.sql import functions as F

from featlake.llm import warc
from featlake.llm.queries import LLM_ORACLES, LLM_QUERIES

SHAPE = "page_id long, url string, html string, file string, digest int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "f", 1) for r in rows], SHAPE).repartition(4)


ROWS = [(i, f"http://x/{i}", "<p>" + "é" * (i % 50) * 40 + "</p>") for i in range(300)] + [(None, None, None), (None, "u", ""), (7, "http://x/7", "again"), (7, "http://x/7", "again"), (900, "long", "x" * 300_000)]


def test_records(spark):
    made = warc.records(pages(spark, ROWS), file_bytes=100_000).collect()
    assert len(made) == len(ROWS) and len({r.file for r in made}) > 3
    for r in made:
        head, body = r.record.split("\r\n\r\n", 1)
        length = int(head.rsplit(" ", 1)[1])
        assert r.length == len(r.record.encode()) and body.encode()[length:] == b"\r\n\r\n"


def test_places_are_disjoint(spark):
    made = warc.records(pages(spark, ROWS), file_bytes=100_000)
    at = {}
    lengths = {(r.page_id, hashlib.sha256(r.record.encode()).hexdigest()): r.length for r in made.collect()}
    for r in warc.leaves(made).collect():
        at.setdefault(r.file, []).append((r.offset, lengths[r.page_id, r.digest]))
    for spans in at.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("span,branch", [(1 << 16, 16), (500, 2), (1, 3)])
def test_audit_finds_exactly_the_faults(spark, monkeypatch, span, branch):
    monkeypatch.setattr(warc, "RANGE_BYTES", span)
    monkeypatch.setattr(warc, "BRANCH", branch)
    a = warc.leaves(warc.records(pages(spark, ROWS), file_bytes=100_000))
    rows = sorted(a.collect(), key=lambda r: (r.file, r.offset))
    changed = {(r.file, r.offset) for r in rows[3::41]}
    gone = {(r.file, r.offset) for r in rows[5::53]} - changed
    top = max(r.offset for r in rows)
    other = [(r.file, r.offset, r.page_id, "bad" if (r.file, r.offset) in changed else r.digest) for r in rows if (r.file, r.offset) not in gone]
    other += [(0, top * 40 + 7, 12345, "new"), (77, 0, 1, "new file")]
    b = spark.createDataFrame(other, "file long, offset long, page_id long, digest string")
    got = {(r.file, r.offset): r.fault for r in warc.audit(a, b).collect()}
    assert got == {**{k: "changed" for k in changed}, **{k: "missing" for k in gone}, (0, top * 40 + 7): "extra", (77, 0): "extra"}
    assert warc.audit(a, a).count() == 0


def test_empty(spark):
    none = warc.leaves(warc.records(pages(spark, [])))
    some = warc.leaves(warc.records(pages(spark, ROWS[:3])))
    assert warc.audit(none, none).count() == 0
    assert [r.fault for r in warc.audit(some, none).collect()] == ["missing"] * 3


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = LLM_QUERIES["op6_warc_fixity"](spark, sf)
    assert oracle.compare(df, oracle.connect(sf), LLM_ORACLES["op6_warc_fixity"]) is None
    assert df.where(F.col("fault") == "extra").count() == 0
