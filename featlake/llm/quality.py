"""Document quality by a regularised quadratic discriminant."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.session import settle

STATISTICS = ["bytes", "words", "word_length", "longest_word", "distinct_words", "upper", "digit", "punctuation", "symbol", "beyond_ascii", "blank",
              "lines", "distinct_lines", "short_words", "long_words", "words_with_symbols", "top_word", "entropy", "sentence_ends", "capital_words"]
CLASSES = np.zeros((6, 256), np.float64)
CLASSES[0, 65:91] = 1                                  # upper case
CLASSES[1, 48:58] = 1                                  # digits
CLASSES[2, list(b".,;:!?'\"()-")] = 1                  # punctuation
CLASSES[3, list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 1        # symbols
CLASSES[4, 128:] = 1                                   # bytes beyond ASCII
CLASSES[5, [9, 10, 11, 12, 13, 32]] = 1                # white space
SYMBOLS = set("#$%&*+/<=>@[\\]^_`{|}~")


def statistics(text: str) -> np.ndarray:
    """Transformed statistics of one text: logarithms of sizes, square roots of shares. All zero for an empty text."""
    out = np.zeros(len(STATISTICS))
    raw = text.encode()
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = CLASSES @ counts / len(raw)
    p = counts[counts > 0] / len(raw)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out[:] = [np.log1p(len(raw)), np.log1p(len(words)), np.log1p(lengths.mean() if len(words) else 0), np.log1p(lengths.max(initial=0)), np.sqrt(len(seen) / n),
              *np.sqrt(shares), np.log1p(len(lines)), np.sqrt(len(set(lines)) / len(lines)), np.sqrt((lengths <= 2).sum() / n), np.sqrt((lengths > 12).sum() / n),
              np.sqrt(sum(c for w, c in seen.items() if not w.isalnum() and not SYMBOLS.isdisjoint(w)) / n), np.sqrt(max(seen.values(), default=0) / n),
              -(p * np.log(p)).sum(), np.sqrt((counts[46] + counts[33] + counts[63]) / n), np.sqrt(sum(c for w, c in seen.items() if w[0].isupper()) / n)]
    return out


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                x = [statistics(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Prior, mean and inverse Cholesky factor of each class; ``share`` answers where a class has no rows."""

    share: float
    centre: np.ndarray
    scale: np.ndarray
    priors: tuple[float, ...] = ()
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of the log densities."""
        if not self.priors:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        log = [np.log(p) + np.log(np.diag(f)).sum() - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for p, m, f in zip(self.priors, self.means, self.factors, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def shrunk(s: np.ndarray, n: int, least: float) -> np.ndarray:
    """Covariance pulled towards a multiple of the identity, by the oracle approximating weight, ``least`` at least."""
    d = len(s)
    trace, square = np.trace(s), (s * s).sum()
    weight = ((1 - 2 / d) * square + trace**2) / max((n + 1 - 2 / d) * (square - trace**2 / d), 1e-12)
    weight = min(1.0, max(least, weight))
    return (1 - weight) * s + (weight * trace / d + 1e-9) * np.eye(d)


def fit(rows: DataFrame, least: float = 0.02) -> Discriminant:
    """``rows`` has ``x`` and ``y`` (0 or 1). Sums and products are added up by place before they reach the driver."""
    d = len(STATISTICS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1))
        for b in batches:
            x = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), np.ones((b.num_rows, 1))], axis=1)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    got = rows.mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # 2 (d + 1)^2 numbers
    total = np.zeros((2, d + 1, d + 1))
    for r in got:
        total.ravel()[r["at"]] = r["value"]
    n = total[:, d, d]
    share = float(n[1] / n.sum()) if n.sum() else 0.5
    both = total.sum(axis=0)
    centre = both[d, :d] / max(1, n.sum())
    scale = np.sqrt(np.maximum(np.diag(both)[:d] / max(1, n.sum()) - centre**2, 1e-6))
    if n.min() < 2:
        return Discriminant(share, centre, scale)
    priors, means, factors = [], [], []
    for c in (0, 1):
        mean = total[c, d, :d] / n[c]
        cov = (total[c, :d, :d] / n[c] - np.outer(mean, mean)) / np.outer(scale, scale)
        priors.append(n[c] / n.sum())
        means.append((mean - centre) / scale)
        factors.append(np.linalg.inv(np.linalg.cholesky(shrunk((cov + cov.T) / 2, int(n[c]), least))))
    return Discriminant(share, centre, scale, tuple(priors), tuple(means), tuple(factors))


def remainder(ident: Column) -> Column:
    return F.crc32(ident.cast("string").cast("binary")) % 3


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Labels are learned from rows whose crc32 of the id as text leaves another remainder than 1 by 3; the others are held
    out. Null ids are not held out and have no label; null labels teach nothing; repeated rows and labels count as often as they
    occur. Null and empty texts are scored like any other (all statistics zero). With fewer than two rows of a class the
    score is the share of class 1 among the labels (0.5 without labels).
    """
    x = settle(with_statistics(docs, id_col, text_col))
    taught = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(F.col("y").isin(0, 1) & (remainder(F.col("id")) != 1))
    model = fit(x.join(taught, "id").select("x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
