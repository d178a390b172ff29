"""Near-duplicate groups by SimHash fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import components, shuffle_partitions
from featlake.llm.superkmer import word_tokens
from featlake.session import settle

SEED = 42
CHUNK = 3 << 20    # bytes of text hashed at a time
ROWS = 255         # rows of bits that one byte can count


def fingerprints_of(texts: list[bytes], words: int) -> np.ndarray:
    """64-bit SimHash of each text over its shingles of ``words`` words, repeats included; 0 without words."""
    tok = word_tokens([t.lower() for t in texts])
    n = np.where(tok.counts >= words, tok.counts - words + 1, np.minimum(tok.counts, 1))
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    n = n[full]
    group = np.repeat(np.arange(len(full)), n)
    place = np.arange(len(group)) - (np.cumsum(n) - n)[group]
    first = (np.cumsum(tok.counts) - tok.counts)[full][group] + place
    last = first + np.minimum(words, tok.counts[full])[group] - 1
    raw = tok.text.tobytes()
    h = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in zip(tok.left[first].tolist(), tok.right[last].tolist(), strict=True)), np.uint64, len(first))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)  # 64 counters of one byte
    starts = np.cumsum(n) - n
    heads = np.flatnonzero(place % ROWS == 0)  # no counter passes 255 within such a part
    parts = np.add.reduceat(bits, heads, axis=0).view(np.uint8).astype(np.int64)
    ones = np.add.reduceat(parts, np.searchsorted(heads, starts), axis=0)
    out[full] = np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, at = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                held.append(text.as_py() or b"")
                size += len(held[-1])
                if size > CHUNK or i + 1 == batch.num_rows or len(held) == 1000:
                    fp = fingerprints_of(held, words).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.array(fp)], ["id", "fp"])
                    held, size, at = [], 0, i + 1

    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return read.mapInArrow(run, "id long, fp long")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): pairs of different fingerprints within ``radius`` bits that connect all such pairs.

    Every distinct fingerprint goes to all points within half the radius; two within the radius meet in a point between
    them. All that meet there lie within the radius of each other, and they are at most as many as the points of the
    ball (65 for radius 2), so one link each to the smallest of them connects what every pair would.
    """
    if radius != 2:
        raise ValueError("the ball is written out for radius 2")
    fp = fps.select("fp").distinct().repartition(shuffle_partitions(fps.sparkSession), "fp")  # few bytes, but each row becomes 65
    near = fp.withColumn("point", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")))
    met = near.groupBy("point").agg(F.collect_list("fp").alias("met")).where(F.size("met") > 1)
    pairs = met.select(F.array_min("met").alias("b"), F.explode("met").alias("a")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: fingerprint and smallest id reachable over links of ``radius`` bits.

    Texts are lower-cased in A-Z and cut at ASCII white space; shingles of ``words`` words count as often as they occur,
    a text of fewer words is one shingle. A bit is set if it is set in over half the hashes. Null and empty texts have
    fingerprint 0 and are linked like any other. A row without id links its text but is never a component's id, which
    is null if no row of the component has one. Repeated rows each get a row. An empty table gives none.
    """
    fps = settle(fingerprints(docs, words, id_col, text_col))
    nodes = fps.groupBy("fp").agg(F.min("id").alias("first"))
    found = components(links(fps, radius))
    roots = settle(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")))
    least = settle(roots.groupBy("root").agg(F.min("first").alias("component_id")))
    lookup = settle(roots.join(least, "root").select("fp", "component_id"))
    return fps.join(lookup, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")
