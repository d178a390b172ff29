"""Helpers shared by the operators of this package."""

from __future__ import annotations

import struct

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.session import settle

U64 = np.uint64


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- packed arrays -----------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string: type, length and bytes of each."""
    parts = []
    for a in arrays:
        parts += [struct.pack("<cQ", a.dtype.char.encode(), a.nbytes), a.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        kind, size = struct.unpack_from("<cQ", raw, at)
        at += 9
        out.append(np.frombuffer(raw, np.dtype(kind.decode()), size // np.dtype(kind.decode()).itemsize, at))
        at += size
    return out


# --- hashes of runs of tokens ------------------------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that their order says nothing about the text."""
    h = h ^ (h >> U64(31))
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def rolled(tokens: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash (modulo 2^64) of every run of ``k`` tokens, by joining runs of doubling length."""
    cur, length, acc, done = tokens, 1, None, 0
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    while True:
        if k & length:
            if acc is None:
                acc, done = cur, length
            else:
                m = len(tokens) - (done + length) + 1
                acc = acc[:m] * U64(pow(BASE, length, 1 << 64))
                acc += cur[done:done + m]
                done += length
        if length * 2 > k:
            return acc[:n]
        m = len(tokens) - 2 * length + 1
        far = cur[length:length + m]
        cur = cur[:m] * U64(pow(BASE, length, 1 << 64))
        cur += far
        length *= 2


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` values, by runs of doubling length."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    length = 1
    while length * 2 <= w:
        a = np.minimum(a[:len(a) - length], a[length:])
        length *= 2
    return np.minimum(a[:n], a[w - length:w - length + n]) if length < w else a[:n]


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes, laid end to end: the group of each place, and the place in its group."""
    group = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - first[group]


# --- connected components ----------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node of each component: rows (node, component) for every node on an edge.

    ``edges`` has two long columns ``a`` and ``b``; direction, repeats and loops do not matter. Every round hangs
    each node below the smallest neighbour of its lower neighbours, then below its own smallest one, until every
    edge leads to a root. All steps are aggregates and joins over tables in the shared folder: nothing is collected,
    a hub's edges are split by adaptive execution, and the number of rounds grows with the logarithm of the size.
    """
    e = settle(_downward(edges.select("a", "b")))
    mark = _mark(e)
    for _ in range(rounds):
        low = settle(_lowest(e))
        e = settle(e.join(low.withColumnsRenamed({"a": "b", "m": "up"}), "b", "left")
                   .select("a", F.coalesce("up", "b").alias("b")).distinct())
        low = settle(_lowest(e))
        down = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = settle(_downward(down.unionByName(low.withColumnRenamed("m", "b"))))
        now = _mark(e)
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = now
    raise RuntimeError(f"no end after {rounds} rounds")


def _downward(e: DataFrame) -> DataFrame:
    return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _lowest(e: DataFrame) -> DataFrame:
    return e.groupBy("a").agg(F.min("b").alias("m"))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
