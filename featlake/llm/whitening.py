"""Whitening of embeddings: principal components by spectral divide and conquer over polar decompositions (QDWH).

The covariance is summed by tasks. Its eigenvectors come from a recursion: with a shift between its eigenvalues, the orthogonal polar
factor of the shifted matrix has the same eigenvectors, and 1 or -1 for each eigenvalue above or below the shift; so half its sum with
the identity projects on the subspace of the upper ones. Orthonormal bases of the two subspaces split the matrix into two smaller ones, until
nothing is left to split. The polar factor is found by dynamically weighted Halley steps, each one QR decomposition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.session import settle

SCALE, SHIFT = 64, 1_000_000  # x = floor(SCALE * c) + SHIFT
COMPONENTS = 16
ROWS = 2_000  # vectors a task works on at a time
EPS = np.finfo(np.float64).eps


# --- the decomposition of a small symmetric matrix -----------------------------------------------------------------


def polar_factor(a: np.ndarray, steps: int = 60) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps."""
    n = len(a)
    x = a / np.linalg.norm(a, 2)
    low = max(EPS, 0.9 * float(np.linalg.svd(x, compute_uv=False)[-1]) / np.sqrt(n))
    for _ in range(steps):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2)) if low < 1 else 0.0
        s = np.sqrt(1 + d)
        wa = s + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - l2) / (l2 * s)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        now = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        now = (now + now.T) / 2
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        change = np.linalg.norm(now - x)
        x = now
        if change <= 4 * n * EPS or (abs(low - 1) < 8 * EPS and change < 1e-8):
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if the matrix is a multiple of the identity as far as doubles tell."""
    n, size = len(a), np.linalg.norm(a)
    mean = np.trace(a) / n
    if n == 1 or np.linalg.norm(a - mean * np.eye(n)) <= 4 * n * EPS * size:
        return None
    best = None
    for nudge in (0.0, 0.03, -0.03, 0.11, -0.11, 0.29, -0.29):
        off = a - mean * np.eye(n)
        p = (polar_factor(off - nudge * np.linalg.norm(off) / np.sqrt(n) * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(p)))
        if not 0 < k < n:
            continue
        upper = np.linalg.qr(p @ np.random.default_rng(1).standard_normal((n, k)))[0]
        upper = np.linalg.qr(p @ upper)[0]
        lower = np.linalg.qr(upper, mode="complete")[0][:, k:]
        left = np.linalg.norm(lower.T @ a @ upper)
        if best is None or left < best[0]:
            best = left, upper, lower
        if left <= 8 * n * EPS * size:
            break
    if best is None:
        raise ArithmeticError("no shift splits the matrix")
    return best[1], best[2]


def eigen(a: np.ndarray, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``first`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Subspaces below the wanted components are left whole.
    """
    n = len(a)
    first = n if first is None else min(first, n)
    values, vectors, todo, above = [], [], [(a, np.eye(n))], 0
    while todo and above < first:  # the uppermost part is on top
        part, basis = todo.pop()
        halves = split(part)
        if halves is None:
            values += [float(part[i, i]) for i in range(len(part))]
            vectors.append(basis)
            above += len(part)
            continue
        for v in (halves[1], halves[0]):
            small = v.T @ part @ v
            todo.append(((small + small.T) / 2, basis @ v))
    v = np.concatenate(vectors, axis=1)
    v = np.linalg.qr(v)[0]
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")[:first]
    return e[order], v[:, order]


# --- sums over the vectors -----------------------------------------------------------------------------------------


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(df: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum of the arrays that ``of_batch`` makes of the vectors: each task adds up its own, Spark those of the tasks, place by place.

    An array holds (d + 1) d numbers at most, so that is what one task hands on and the driver gets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                now = of_batch(b.slice(at, ROWS))
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    got = df.mapInArrow(run, f"at long, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(len(got), np.int64 if kind == "long" else np.float64)
    out[got["at"].to_numpy()] = got["v"].to_numpy()
    return out


def quantised(df: DataFrame, keep: list[str], vector: str) -> DataFrame:
    """``keep`` columns and ``x``, the vectors as whole numbers; rows whose vector is null or holds null or non-finite entries go."""
    c = F.col(f"`{vector}`")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + SHIFT)
    return df.where(c.isNotNull() & ~bad).select(*[F.col(f"`{k}`") for k in keep], x.alias("x"))


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each usable vector and component.

    Covariances are over the different quantised vectors, each counted once (n of them). Components are numbered from 1 by falling
    eigenvalue; those without variance (below 1e-13 of the trace) are left out, as nothing can be divided by their spread: a table
    of equal vectors, or of none, gives no rows. Vectors that are null, or hold null or non-finite entries, are dropped; so are
    those of another length than the most frequent one (ties: the longest), which lack entries or have too many. Null and repeated ids are
    kept as they are. ``deviation`` is exact, and an error where it would not fit 64 bits. Other columns are not read.
    """
    rows = settle(quantised(df, [id_col], vector).withColumnRenamed(id_col, "vec"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = f"vec {dict(rows.dtypes)['vec']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = df.sparkSession.createDataFrame([], schema).withColumnRenamed("vec", id_col)
    if not sizes:
        return empty
    d = sizes[0]["d"]
    rows = rows.where(F.size("x") == d)
    fit = settle(rows.select("x").distinct())

    def totals(b: pa.RecordBatch) -> np.ndarray:
        return np.append(_matrix(b.column(0), d).sum(axis=0), b.num_rows)

    sums = _summed(fit, totals, "long")
    n, s = int(sums[-1]), [int(v) for v in sums[:-1]]
    near = np.array([v // n for v in s])  # whole part of the mean, taken off exactly
    rest = np.array([(v % n) / n for v in s])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - near).astype(np.float64) - rest

    def products(b: pa.RecordBatch) -> np.ndarray:
        x = centred(_matrix(b.column(0), d))
        return x.T @ x

    v = _summed(fit, products).reshape(d, d) / n
    v = (v + v.T) / 2
    trace = float(np.trace(v))
    if trace <= 0:
        return empty
    e, vectors = eigen(v, components)
    good = e > 1e-13 * trace
    e, vectors = e[good], vectors[:, good]
    k = len(e)
    base = vectors / np.sqrt(e)

    def squares(b: pa.RecordBatch) -> np.ndarray:
        z = centred(_matrix(b.column(0), d)) @ base
        return np.vstack([z.T @ z, z.sum(axis=0)])

    z = _summed(fit, squares).reshape(k + 1, k)
    error = float(np.abs(z[:k] / n - np.outer(z[k] / n, z[k] / n) - np.eye(k)).max())
    explained = e / trace
    total = np.array([int(t) for t in s], dtype=object)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                b = whole_batch.slice(at, ROWS)
                x = _matrix(b.column(1), d)
                about = (centred(x) ** 2).sum(axis=1).max() * float(n) ** 2
                if about < 2.0**61 and n * float(np.abs(x).max()) < 2.0**61:
                    dev = ((n * x - total.astype(np.int64)) ** 2).sum(axis=1)
                else:
                    dev = [int(r) for r in ((n * x.astype(object) - total) ** 2).sum(axis=1)]
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                     pa.array(np.repeat(np.array(dev, np.int64), k)), pa.array((centred(x) @ base).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    ["vec", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, schema).withColumnRenamed("vec", id_col)
