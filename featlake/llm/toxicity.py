"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.session import settle

#: Categories before the last, told apart among documents labelled toxic by words; only training labels look at them.
SEEDS = {
    "insult": frozenset(["clown", "dumb", "fool", "idiot", "loser", "moron", "stupid"]),
    "contempt": frozenset(["disgusting", "filth", "pathetic", "scum", "trash", "vermin", "worthless"]),
}
CHAIN = [*SEEDS, "toxic"]
MAX_ROWS = 20_000    # labelled rows to learn from at most, those with the least hashes
MAX_TERMS = 2_000    # terms a model may look at
PREFIXES = range(3, 8)
FOLDS = 3
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_"


def words_of(text: str | None) -> set[str]:
    return {w.strip(EDGES) for w in (text or "").lower().split()}


def terms_of(words: set[str]) -> set[str]:
    """Words and the beginnings (marked by a star) of longer words."""
    return {*words, *(w[:n] + "*" for n in PREFIXES for w in words if len(w) > n)} - {""}


@dataclass
class Chain:
    """Terms, and for each category its weights on terms, on the earlier categories' probabilities, and the constant."""

    terms: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.whole = frozenset(t for t in self.terms if not t.endswith("*"))
        self.lengths = sorted({len(t) - 1 for t in self.terms if t.endswith("*")})

    def found(self, text: str | None) -> list[int]:
        words = words_of(text)
        hits = set(words & self.whole)
        for n in self.lengths:
            hits.update({w[:n] + "*" for w in words if len(w) > n} & self.terms.keys())
        return sorted(self.terms[t] for t in hits)

    def score(self, rows: list[list[int]]) -> np.ndarray:
        """Probability of each category, one column each, in the order of the chain."""
        out = np.zeros((len(rows), len(self.weights)))
        at, group = flat(rows)
        for c, w in enumerate(self.weights):
            z = np.bincount(group, w[at], len(rows)) + out[:, :c] @ w[len(self.terms):len(self.terms) + c] + w[-1]
            out[:, c] = sigmoid(z)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return (np.fromiter((t for r in rows for t in r), np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]))


def logistic(rows: list[list[int]], extra: np.ndarray, y: np.ndarray, n_terms: int, penalty: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Weights on terms and extra columns and a constant, by accelerated gradient steps on the penalised log loss."""
    at, group = flat(rows)
    n, m = len(y), extra.shape[1]
    if not n or y.min() == y.max():
        w = np.zeros(n_terms + m + 1)
        w[-1] = -4.0 if not n or y[0] == 0 else 4.0
        return w
    longest = max(1, max(map(len, rows), default=1))
    step = 1 / (0.25 * n * (longest + m + 1) + penalty)
    # terms are few in most rows: a step of its own for each weight, from what its rows can add to the curvature
    size = np.array([len(r) for r in rows], float) + m + 1
    own = np.concatenate([np.bincount(at, size[group], n_terms), np.abs(extra).T @ size if m else np.zeros(0), [size.sum()]])
    step = np.maximum(step, 1 / (0.25 * own + penalty))
    w = np.zeros(n_terms + m + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        miss = sigmoid(np.bincount(group, ahead[at], n) + extra @ ahead[n_terms:-1] + ahead[-1]) - y
        grad = np.concatenate([np.bincount(at, miss[group], n_terms), extra.T @ miss, [miss.sum()]])
        grad[:-1] += penalty * ahead[:-1]
        new = ahead - step * grad
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / nxt * (new - w), new, nxt
    return w


def fit_chain(rows: list[list[int]], targets: np.ndarray, fold: np.ndarray, terms: dict[str, int]) -> Chain:
    """One model after the other; a later one learns from what the earlier ones say about rows they have not seen."""
    chain = Chain(terms)
    earlier = np.zeros((len(rows), 0))
    for c in range(targets.shape[1]):
        y = targets[:, c].astype(float)
        unseen = np.zeros(len(rows))
        for f in range(FOLDS):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            w = logistic([rows[i] for i in train], earlier[train], y[train], len(terms))
            at, group = flat([rows[i] for i in test])
            unseen[test] = sigmoid(np.bincount(group, w[at], len(test)) + earlier[test] @ w[len(terms):-1] + w[-1])
        chain.weights.append(logistic(rows, earlier, y, len(terms)))
        earlier = np.column_stack([earlier, unseen])
    return chain


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> Chain:
    """Fit on at most ``max_rows`` labelled rows. Terms are counted in Spark, pre-aggregated; the driver gets the chosen
    terms and, for each sampled row, the few of them that it has."""
    known = (labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
             .where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y")))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = settle(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")
                   .groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for b in batches:
            for y, text in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                seen[y].update(terms_of(words_of(text.as_py())))
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield counted(seen)
                    seen = (Counter(), Counter())
        yield counted(seen)

    def counted(seen):
        terms = [*seen[0], *seen[1]]
        zero = np.zeros(len(terms), np.int64)
        zero[:len(seen[0])] = list(seen[0].values())
        one = np.zeros(len(terms), np.int64)
        one[len(seen[0]):] = list(seen[1].values())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(zero), pa.array(one)], ["term", "zero", "one"])

    n0, n1 = (texts.where(F.col("y") == y).count() for y in (0, 1))
    share = n1 / max(1, n0 + n1)
    p = (F.col("zero") + F.col("one")) / F.lit(max(1, n0 + n1))
    z = (F.col("one") / max(1, n1) - F.col("zero") / max(1, n0)) / F.sqrt(p * (1 - p) * (1 / max(1, n0) + 1 / max(1, n1)) + 1e-12)
    best = (texts.mapInArrow(count, "term string, zero long, one long").groupBy("term").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
            .where((F.col("zero") + F.col("one") >= 5) & (F.abs(z) >= 4.5)).orderBy(F.abs(z).desc(), "term").limit(MAX_TERMS).select("term").collect())
    terms = {r["term"]: i for i, r in enumerate(best)}
    chain = Chain(terms)
    seeds = list(SEEDS.values())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            kinds = [[not s.isdisjoint(words_of(t)) for s in seeds] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([chain.found(t) for t in texts], pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.bool_()))], ["id", "y", "terms", "kinds"])

    rows = texts.mapInArrow(encode, "id long, y int, terms array<int>, kinds array<boolean>").collect()  # max_rows at most
    rows.sort(key=lambda r: r["id"])
    y = np.array([r["y"] for r in rows], np.int64)
    targets = np.column_stack([*[y * np.array([r["kinds"][c] for r in rows], np.int64) for c in range(len(seeds))], y]) if rows else np.zeros((0, len(CHAIN)))
    fold = np.array([zlib.crc32(str(r["id"]).encode()) // 3 % FOLDS for r in rows], np.int64)
    del share
    return fit_chain([r["terms"] for r in rows], targets, fold, terms)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, p_insult, p_contempt, p_toxic, toxic) of every row.

    The chain predicts insult, then contempt, then toxicity as such; each model sees the presence of terms and the
    probabilities of the categories before it, in training those of models that have not seen the row. A row is toxic from
    ``threshold`` on. Null and empty texts have no terms and get the constant; null ids are scored but teach nothing;
    of repeated ids the toxic label and the least text teach; without labels nothing is toxic.
    """
    chain = learn(docs, labels, id_col, text_col, label_col, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.score([chain.found(t.as_py()) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(p[:, c])) for c in range(len(CHAIN))]], ["row", *[f"p_{c}" for c in CHAIN]])

    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    shape = read.select("row", *[F.lit(0.0).alias(f"p_{c}") for c in CHAIN]).schema
    return read.mapInArrow(run, shape).withColumn("toxic", F.col("p_toxic") >= threshold)
