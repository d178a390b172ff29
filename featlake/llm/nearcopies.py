"""Near copies by the share of common shingles.

Candidates come first from SimHash: texts whose fingerprints of 64 bits are equal or linked by two bits. But a SimHash
differs in about ten bits (deviation three) between two texts that share 0.8 of their shingles, too many for a ball. So
further candidates come from several short fingerprints: each band of ``ROWS`` minima of scrambled shingle
hashes is one, and two texts of similarity s agree in it with probability s^ROWS. With 24 bands a pair of similarity 0.8
meets in one at least with probability 0.9993. The shingles themselves then decide, so nothing below the bound is joined.

Equal sets are one node from the start. In each band all nodes are compared with one of them first, and what is near hangs together. Bands whose
nodes all hang in one component are done: more links would say nothing new. What is left is joined exactly: the shingles of the
nodes left are ordered by rarity among them, and two sets that share 0.8 have a shingle in common among their first ones, as many as
their sizes allow to differ. A node goes to a key for each such shingle and each band of sizes that a partner may have, so the sizes
bound the prefixes tightly: a copy with many shingles of its own meets nobody. These keys are met like the bands, by ``LEADERS`` rounds of one
node with all others, then by all pairs of different components that their places, sizes and marks still allow. A set's marks say of
each of ``MARKS`` cells whether an odd number of its shingles falls there: two sets differ in as many shingles as marks, at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import U64, components, mixed, pack, rolled, unpack
from featlake.llm.simhash import fingerprints_of
from featlake.llm.simhash import links as fingerprint_links
from featlake.llm.superkmer import word_tokens
from featlake.session import settle

FP_WORDS = 3  # words of a shingle of the SimHash
BANDS, ROWS = 24, 6
LEADERS = 1
SIZE = 1.05  # sizes of a band of sizes, largest to smallest
MARKS = 512
FLUSH = 200_000  # rows handed on at once
CHUNK = 512 << 10  # bytes of text described at a time; what is worked out of them takes about forty times that
FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Distinct hashes of each text's shingles, in order; a shorter text is one shingle, one without words has the hash 0."""
    tok = word_tokens([t.lower() for t in texts])
    hashes = mixed(rolled(tok.hashes, words))
    ends = np.cumsum(tok.counts)
    out = []
    for a, b in zip((ends - tok.counts).tolist(), ends.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(hashes[a:b - words + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(tok.hashes[a:b].tobytes()) if b > a else 0], U64))
    return out


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BANDS`` keys for each set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), BANDS), U64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, U64)
        for factor in FACTORS[b * ROWS:(b + 1) * ROWS]:
            key = mixed(key * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * factor, starts))
        out[:, b] = key
    return out


def described(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, hash) as (id, hash, node, fp, bands, shingles): a hash of the set of shingles, the SimHash fingerprint, the set's keys, and 32 bits of each shingle, packed."""
    for batch in batches:
        held, size, at = [], 0, 0
        for i, text in enumerate(batch.column(1)):
            held.append(text.as_py() or b"")
            size += len(held[-1])
            if size > CHUNK or i + 1 == batch.num_rows:
                sets = shingle_sets(held, words)
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], U64).view(np.int64)
                short = [pack(np.diff(np.unique(s >> U64(32)), prepend=U64(0)).astype(np.uint32)) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), batch.column(2).slice(at, len(held)), pa.array(node), pa.array(fingerprints_of(held, FP_WORDS).view(np.int64)),
                                                  pa.array(list(bands_of(sets).view(np.int64)), pa.list_(pa.int64())), pa.array(short, pa.binary())], ["id", "hash", "node", "fp", "bands", "shingles"])
                held, size, at = [], 0, i + 1


def similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, and the shingles of both), the pairs whose shingles in common are ``least`` of all theirs at least."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.cumsum(unpack(z.as_py())[0].astype(np.int64)) for z in (x, y))
            common = 0
            if min(len(x), len(y)) >= least * max(len(x), len(y)):
                common = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(common >= least * (len(x) + len(y) - common))
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def checked(rows: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes that share enough, each once."""
    pairs = settle(pairs.distinct())
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = settle(rows.join(settle(used), "node", "left_semi").groupBy("node").agg(F.min("shingles").alias("s")))
    both = pairs.join(sets.withColumnsRenamed({"node": "b", "s": "t"}), "b").join(sets.withColumnRenamed("node", "a"), "a").select("a", "b", "s", "t")
    return settle(both.mapInArrow(lambda it: similar(it, least), "a long, b long"))


def by_fingerprint(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose SimHash fingerprints are equal or linked: a node of each fingerprint stands for it."""
    fps = settle(rows.select("fp", "node").distinct())
    one = settle(fps.groupBy("fp").agg(F.min("node").alias("one")))
    same = fps.join(one, "fp").select(F.col("node").alias("a"), F.col("one").alias("b"))
    near = fingerprint_links(fps).join(one.withColumnsRenamed({"fp": "a", "one": "x"}), "a").join(one.withColumnsRenamed({"fp": "b", "one": "y"}), "b")
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a <> b")


def _apart(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``keys`` (node, key, ...) whose key holds nodes of several components, with the component as ``root``."""
    now = settle(keys.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component"))
    several = now.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("key")
    return now.join(settle(several), "key", "left_semi")


def _with_least(keys: DataFrame) -> DataFrame:
    """Each key's smallest node with all others of the key; those of other components, where these are known."""
    known = "root" in keys.columns
    one = keys.groupBy("key").agg(F.min("node").alias("one"), *([F.min_by("root", "node").alias("of")] if known else []), F.count("*").alias("n")).where("n > 1")
    met = keys.join(settle(one), "key").where("root <> of" if known else "node <> one")
    return met.select(F.col("node").alias("a"), F.col("one").alias("b"))


def _with_all(keys: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """All pairs of a key that are of different components, share enough if nothing before the key's shingle is in common and all after it is, and do not differ in more marks than that leaves."""
    names = [f"m{i}" for i in range(MARKS // 64)]
    x = settle(keys.join(marks, "node"))
    y = x.select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "root", "place", "size", *names)])
    most, both = F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2")), F.col("size") + F.col("size2")
    apart = reduce(add, [F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}2"))) for m in names])
    near = x.join(y, "key").where((F.col("node") > F.col("node2")) & (F.col("root") != F.col("root2")) & (most * (1 + least) >= both * least - 1e-6)
                                  & (apart * (1 + least) <= both * (1 - least) + 1e-6))
    return near.select(F.col("node").alias("a"), F.col("node2").alias("b"))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, shingles) as (node, m0, m1, ...): the marks of the set, 64 in each."""
    for batch in batches:
        out = np.zeros((batch.num_rows, MARKS // 64), np.int64)
        for i, s in enumerate(batch.column(1)):
            cell = mixed(np.cumsum(unpack(s.as_py())[0].astype(U64))) & U64(MARKS - 1)
            out[i] = np.packbits((np.bincount(cell.astype(np.int64), minlength=MARKS) & 1).astype(np.uint8)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in out.T]], ["node", *[f"m{i}" for i in range(MARKS // 64)]])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, shingles) as one row (node, token) for each shingle."""
    for batch in batches:
        held, size = [], 0
        for i, (node, s) in enumerate(zip(batch.column(0).to_numpy(), batch.column(1), strict=True), 1):
            token = np.cumsum(unpack(s.as_py())[0].astype(np.int64))
            held.append((np.full(len(token), node), token))
            size += len(token)
            if size > FLUSH or i == batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["node", "token"])
                held, size = [], 0


def _prefix_keys(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (node, tokens from rare to frequent) as (node, key, place, size)."""
    def band(n: int) -> int:
        return int(np.log(max(1, n)) / np.log(SIZE) + 1e-9)

    for batch in batches:
        held, size = [], 0
        for i, (node, tokens) in enumerate(zip(batch.column(0).to_numpy(), batch.column(1), strict=True), 1):
            t = tokens.values.to_numpy().view(U64) * U64(0x9E3779B97F4A7C15)
            n = len(t)
            low, high, own = int(np.ceil(least * n - 1e-6)), int(np.floor(n / least + 1e-6)), band(n)
            for other in range(band(low), band(high) + 1):
                smallest = max(low, int(np.ceil(SIZE**other - 1e-6)))
                k = min(n, n - int(np.ceil(least / (1 + least) * (n + smallest) - 1e-6)) + 1)
                if k > 0:
                    key = mixed(t[:k] + U64(min(own, other) * 65_536 + max(own, other)))
                    held.append((np.full(k, node), key.view(np.int64), np.arange(k), np.full(k, n)))
                    size += k
            if held and (size > FLUSH or i == batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["node", "key", "place", "size"])
                held, size = [], 0


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(node, key, place, size): keys in which any two of the sets (node, shingles) that share ``least`` meet."""
    token = settle(sets.mapInArrow(_tokens, "node long, token long"))
    often = settle(token.groupBy("token").agg(F.count("*").alias("n")))
    ordered = token.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    return ordered.select("node", F.col("t.token").alias("t")).mapInArrow(lambda it: _prefix_keys(it, least), "node long, key long, place long, size long")


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, root, component_id) of every row: ``xxhash64`` of the text, a number of its component, and smallest id reachable over pairs that share ``least`` of their distinct shingles at least.

    Texts are lower-cased in A-Z and cut at ASCII white space; a text of fewer than ``words`` words is one shingle. Null
    texts and texts without words are copies of each other. A row without id links its text but is never a component's
    id, which is null if no row of the component has one. Pairs of just ``least`` are missed with probability 0.0007.
    """
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"), F.xxhash64(f"`{text_col}`").alias("hash"))
    rows = settle(read.mapInArrow(lambda it: described(it, words), "id long, hash long, node long, fp long, bands array<long>, shingles binary"))
    each = rows.select("node", F.explode("bands").alias("key"))
    several = settle(each.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi").select("key"))
    bands = settle(each.join(several, "key", "left_semi").distinct())
    links = checked(rows, by_fingerprint(rows).unionByName(_with_least(bands)), least)
    roots = settle(components(links))
    apart = settle(_apart(bands, roots).select("node").distinct())
    if not apart.isEmpty():
        sets = settle(rows.join(apart, "node", "left_semi").groupBy("node").agg(F.min("shingles").alias("shingles")))
        keys = settle(prefixes(sets, least))
        for turn in range(LEADERS + 1):
            left = settle(_apart(keys, roots))
            if left.isEmpty():
                break
            if turn < LEADERS:
                found = checked(rows, _with_least(left), least)
            else:
                marks = sets.mapInArrow(_marks, "node long, " + ", ".join(f"m{i} long" for i in range(MARKS // 64)))
                found = checked(rows, _with_all(left, settle(marks), least), least)
            keys = left.drop("root")  # components only grow, so a key that is done stays done
            if not found.isEmpty():
                links = settle(links.unionByName(found))
                roots = settle(components(links))
    nodes = rows.groupBy("node").agg(F.min("id").alias("first"))
    hung = settle(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("component", "node").alias("root")))
    smallest = settle(hung.groupBy("root").agg(F.min("first").alias("component_id")))
    lookup = settle(hung.join(smallest, "root").select("node", "root", "component_id"))
    return rows.select("id", "hash", "node").join(lookup, "node").select(F.col("id").alias("doc_id"), "hash", "root", "component_id")
