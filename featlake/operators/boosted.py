"""Boosted trees (J7, J8, J12, J13) grown from cells: all folds and seeds from one pass over the rows.

A tree sees a row only through the bins of its features, so rows of equal bins, their number, the sum and the sum of squares of their targets are all that
the trees need: the result is that of Spark ML on the rows themselves, whose cuts and rules these are. A model with few cells grows in one
task; one with more than ``CELLS`` grows by sums that the tasks hand on, a level at a time, and only the trees reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.session import dealt, drop, settle

CELLS = 1 << 21  # of one model in one task
RATE = 0.1  # weight of every tree but the first
NOISE = 1e-12


def split_points(est: Estimator, df: DataFrame) -> list[np.ndarray] | None:
    """The cuts between the bins of each feature that ``est`` takes from the rows; None if a feature is categorical."""
    jvm = df.sparkSession._jvm
    single = lambda package, name: getattr(getattr(package, f"{name}$"), "MODULE$")
    kinds = jvm.org.apache.spark.ml.util.MetadataUtils.getCategoricalFeatures(df._jdf.schema().apply(est.getFeaturesCol()))
    if not kinds.isEmpty():
        return None
    est._transfer_params_to_java()
    classes = jvm.scala.Some(2) if est.getLossType() == "logistic" else jvm.scala.Option.empty()
    rows = single(jvm.org.apache.spark.ml.util, "DatasetUtils").extractInstances(est._java_obj, df._jdf, classes)
    plan = est._java_obj.getOldBoostingStrategy(kinds, jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression()).treeStrategy()
    meta = jvm.org.apache.spark.ml.tree.impl.DecisionTreeMetadata.buildMetadata(rows, plan, 1, est.getFeatureSubsetStrategy())
    found = single(jvm.org.apache.spark.ml.tree.impl, "RandomForest").findSplits(rows, meta, est.getSeed())
    return [np.array([c.threshold() for c in cuts]) for cuts in found]


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of cuts below it."""
    return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


@dataclass
class Trees:
    """Trees of one model in heap order: feature (-1: leaf), last bin that goes left, and value."""

    feature: np.ndarray
    last: np.ndarray
    value: np.ndarray

    def node(self, tree: int, bins: np.ndarray, level: int) -> np.ndarray:
        at, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(level):
            f = self.feature[tree][at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[every, np.maximum(f, 0)] > self.last[tree][at]), at)
        return at

    def sum(self, bins: np.ndarray, depth: int) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in range(len(self.feature)):
            out += (1.0 if t == 0 else RATE) * self.value[t][self.node(t, bins, depth)]
        return out


def _slopes(c: dict[str, np.ndarray], first: bool, logistic: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums over each cell of what the next tree is fitted to, and of its squares."""
    if first:
        return c["s"], c["q"]
    if logistic:
        y = c["s"] / c["n"]  # cells of this kind hold one class
        r = 4 * y / (1 + np.exp(2 * y * c["p"]))
        return c["n"] * r, c["n"] * r * r
    return 2 * (c["s"] - c["n"] * c["p"]), 4 * (c["q"] - 2 * c["p"] * c["s"] + c["n"] * c["p"] ** 2)


def _level(trees: Trees, c: dict[str, np.ndarray], at_tree: int, level: int, width: int, logistic: bool) -> np.ndarray:
    """Sums (n, target, its square) for each node of the level, feature and bin."""
    bins, d, first = c["bins"], c["bins"].shape[1], 2**level - 1
    at = trees.node(at_tree, bins, level) - first
    ok = (at >= 0) & (c["v"] == 0)
    out = np.zeros((2**level, d, width, 3))
    kinds = [a[ok] for a in (c["n"], *_slopes(c, at_tree == 0, logistic))]
    at, bins = at[ok], bins[ok]
    for f in range(d):
        place = at * width + bins[:, f]
        for i, w in enumerate(kinds):
            out[:, f, :, i] = np.bincount(place, w, 2**level * width).reshape(-1, width)
    return out


def _impurity(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    m = np.maximum(n, 1)
    return (q - s * s / m) / m


def _split(trees: Trees, tree: int, level: int, sums: np.ndarray, deepest: bool, closed: np.ndarray) -> None:
    """Values of the level's nodes, and the best cut of those that are not leaves. ``closed`` marks nodes that are not to be split."""
    first, total = 2**level - 1, sums[:, 0].sum(axis=1)
    n, s, q = total.T
    seen = n > 0
    trees.value[tree][first:first + 2**level][seen] = s[seen] / n[seen]
    if deepest:
        return
    left = sums.cumsum(axis=2)
    right = total[:, None, None] - left
    (ln, ls, lq), (rn, rs, rq) = np.moveaxis(left, 3, 0), np.moveaxis(right, 3, 0)
    share = np.maximum(n, 1)[:, None, None]
    low, high = _impurity(ln, ls, lq), _impurity(rn, rs, rq)
    gain = _impurity(n, s, q)[:, None, None] - ln / share * low - rn / share * high
    gain = np.where((ln > 0.5) & (rn > 0.5), gain, -np.inf).reshape(2**level, -1)
    noise = NOISE * q / np.maximum(n, 1)  # of the impurities, by rounding
    best = (gain >= (gain.max(axis=1) - noise)[:, None]).argmax(axis=1)  # of equal gains the first feature and least cut, whatever the order of the sums
    nodes = np.arange(2**level)
    go = seen & (gain[nodes, best] > noise) & ~closed[first:first + 2**level]
    trees.feature[tree][first:first + 2**level] = np.where(go, best // sums.shape[2], -1)
    trees.last[tree][first:first + 2**level] = best % sums.shape[2]
    tiny = np.finfo(float).eps
    for side, off in ((low, 1), (high, 2)):
        closed[2 * (first + nodes) + off] = np.abs(side.reshape(2**level, -1)[nodes, best]) < tiny


def _boost(models: list[int], features: int, width: int, depth: int, most: int, gain: float | None, logistic: bool,
           total: Callable, advance: Callable) -> dict[int, Trees]:
    """Trees of the models. ``total(fn)`` adds up fn(model, cells) over all cells of a model, for each model; ``advance(fn)`` moves the cells' values by it."""
    size = 2 ** (depth + 1) - 1
    out = {m: Trees(np.full((0, size), -1), np.zeros((0, size), np.int64), np.zeros((0, size))) for m in models}
    alive, best, kept = set(models), {}, {m: 0 for m in models}
    for t in range(most):
        for m in alive:
            for name, fill in (("feature", -1), ("last", 0), ("value", 0)):
                a = getattr(out[m], name)
                setattr(out[m], name, np.vstack([a, np.full((1, size), fill, a.dtype)]))
        closed = {m: np.zeros(size, bool) for m in alive}
        for level in range(depth + 1):
            for m, sums in total(lambda m, c: _level(out[m], c, t, level, width, logistic), (2**level, features, width, 3), alive).items():
                _split(out[m], t, level, sums, level == depth, closed[m])
            if not any((out[m].feature[t][2**level - 1:2 ** (level + 1) - 1] >= 0).any() for m in alive):
                break
        advance(lambda m, c: c["p"] + ((1.0 if t == 0 else RATE) * out[m].value[t][out[m].node(t, c["bins"], depth)] if m in alive else 0.0))
        if gain is None:
            continue
        missed = lambda m, c: np.stack([((c["v"] == 1) * a).sum() for a in (c["n"], c["q"] - 2 * c["p"] * c["s"] + c["n"] * c["p"] ** 2)])
        for m, (n, e) in total(missed, (2,), alive).items():
            now = e / n
            if t and best[m] - now < gain * max(now, 0.01):
                alive.discard(m)
            elif t == 0 or now < best[m]:
                best[m], kept[m] = now, t + 1
        if not alive:
            break
    if gain is not None:
        out = {m: Trees(t.feature[:kept[m]], t.last[:kept[m]], t.value[:kept[m]]) for m, t in out.items()}
    return out


def _cells_of(b: pa.RecordBatch, features: int) -> dict[str, np.ndarray]:
    key = b.column(b.schema.get_field_index("key"))
    ends = np.frombuffer(key.buffers()[1], np.int32)[key.offset:key.offset + b.num_rows + 1]
    wide = np.frombuffer(key.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    got = {c: b.column(b.schema.get_field_index(c)).to_numpy() for c in ("m", "v", "n", "s", "q", "p")}
    return got | {"bins": wide.reshape(b.num_rows, -1)[:, :features]}


def _of(c: dict[str, np.ndarray], m: int) -> dict[str, np.ndarray]:
    here = c["m"] == m
    return {k: a[here] for k, a in c.items()}


def cells(rows: DataFrame, cuts: list[list[np.ndarray]], folds: list[int], valid: bool, logistic: bool) -> DataFrame:
    """(m, v, key, n, s, q, p) of (x, y, fold): the rows of equal bins of each model; with ``valid`` also those of the fold it leaves out (v = 1).

    The key is one byte for each feature; for two classes, 0 and 1, also one for the class, whose target is -1 or 1.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, fold = _matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
            for m, (c, f) in enumerate(zip(cuts, folds)):
                use = np.arange(len(y)) if valid else np.flatnonzero(fold != f)
                key, t = _bins(x[use], c), y[use]
                if logistic:
                    key, t = np.hstack([key, t[:, None].astype(np.uint8)]), 2 * t - 1
                d = key.shape[1]
                packed = pa.Array.from_buffers(pa.binary(), len(use), [None, pa.py_buffer((np.arange(len(use) + 1, dtype=np.int32) * d).tobytes()), pa.py_buffer(key.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), m, np.int32)), pa.array((fold[use] == f).astype(np.int32)), packed, pa.array(t), pa.array(t * t)], ["m", "v", "key", "y", "z"])

    binned = rows.select("x", "y", "fold").mapInArrow(run, "m int, v int, key binary, y double, z double")
    return binned.groupBy("m", "v", "key").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"), F.sum("z").alias("q")).withColumn("p", F.lit(0.0))


def _in_tasks(state: DataFrame, features: int, grow: Callable) -> dict[int, Trees]:
    """Each model in one task."""
    def run(table: pa.Table) -> pa.Table:
        c = _cells_of(table.combine_chunks().to_batches()[0], features)
        m = int(c["m"][0])

        def advance(fn: Callable) -> None:
            c["p"] = fn(m, c)
        t = grow([m], lambda fn, shape, alive: {m: fn(m, c)}, advance)[m]
        return pa.table({"m": pa.array([m], pa.int32()), **{k: [getattr(t, k).ravel().astype(float)] for k in ("feature", "last", "value")}, "size": pa.array([t.feature.shape[1]], pa.int32())})

    got = state.groupBy("m").applyInArrow(run, "m int, feature array<double>, last array<double>, value array<double>, size int").collect()
    return {r["m"]: Trees(*[np.array(r[k]).astype(kind).reshape(-1, r["size"]) for k, kind in (("feature", int), ("last", int), ("value", float))]) for r in got}


def _in_passes(state: DataFrame, features: int, models: list[int], grow: Callable) -> dict[int, Trees]:
    """All models by sums over the tasks; the cells' values are kept in the table."""
    at = [state]

    def total(fn: Callable, shape: tuple[int, ...], alive: set[int]) -> dict[int, np.ndarray]:
        some = sorted(alive)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(some), *shape))
            for b in batches:
                if b.num_rows:
                    c = _cells_of(b, features)
                    for i, m in enumerate(some):
                        if (c["m"] == m).any():
                            sums[i] += fn(m, _of(c, m))
            where = np.flatnonzero(sums.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(sums.ravel()[where])], ["at", "x"])

        got = at[0].mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros(len(some) * int(np.prod(shape)))
        out[got.column("at").to_numpy()] = got.column("x").to_numpy()
        return dict(zip(some, out.reshape(-1, *shape)))

    def advance(fn: Callable) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    c = _cells_of(b, features)
                    p = c["p"].copy()
                    for m in np.unique(c["m"]):
                        p[c["m"] == m] = fn(int(m), _of(c, m))
                    yield b.set_column(b.schema.get_field_index("p"), "p", pa.array(p))
        before, at[0] = at[0], settle(at[0].mapInArrow(run, at[0].schema))
        if before is not state:
            drop(before)
    out = grow(models, total, advance)
    if at[0] is not state:
        drop(at[0])
    return out


@dataclass
class Boosted:
    """Models with their cuts and trees, one for each (seed, left-out fold), folds of a seed side by side."""

    folds: list[int]
    depth: int
    logistic: bool
    cuts: list[list[np.ndarray]]
    trees: list[Trees]

    def predicted(self, features: str, fold: Column, seed: int = 0) -> Column:
        """Value of the model that leaves the row's fold out; the mean of the models of the seed for rows without a fold."""
        n, folds, depth, logistic = len(self.folds), self.folds, self.depth, self.logistic
        cuts, trees = self.cuts[seed * n:seed * n + n], self.trees[seed * n:seed * n + n]

        @F.arrow_udf("double")
        def value(x: pa.Array, fold: pa.Array) -> pa.Array:
            x, loose = _matrix(x), fold.is_null().to_numpy(zero_copy_only=False)
            own, out = fold.fill_null(-1).to_numpy(zero_copy_only=False), np.zeros(len(loose))
            for f, c, t in zip(folds, cuts, trees):
                use = loose | (own == f)
                p = t.sum(_bins(x[use], c), depth)
                out[use] += 1 / (1 + np.exp(-2 * p)) if logistic else p
            return pa.array(np.where(loose, out / n, out))

        return value(vector_to_array(features), fold.cast("int"))


def boosted_models(ests: list[Estimator], train: DataFrame, fold: str, folds: list[int], label: str = "label", gain: float | None = None) -> Boosted | None:
    """A model for each of ``ests``, which differ in their seed, and left-out fold. With ``gain`` it stops by the left-out fold, as ``validationTol`` does.

    None if features are categorical.
    """
    known = train.where(F.col(fold).isNotNull())
    logistic = ests[0].getLossType() == "logistic"
    found = [split_points(e, known.where(F.col(fold) != f)) for e in ests for f in folds]
    if any(c is None for c in found):
        return None
    features, depth, most = len(found[0]), ests[0].getMaxDepth(), ests[0].getMaxIter()
    width = 1 + max((len(c) for cuts in found for c in cuts), default=0)
    rows = known.select(vector_to_array(ests[0].getFeaturesCol()).alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
    state = settle(cells(dealt(rows), found, folds * len(ests), gain is not None, logistic))
    models = list(range(len(found)))

    def grow(some: list[int], total: Callable, advance: Callable) -> dict[int, Trees]:
        return _boost(some, features, width, depth, most, gain, logistic, total, advance)

    largest = state.groupBy("m").count().agg(F.max("count")).first()[0] or 0
    trees = _in_tasks(state, features, grow) if largest <= CELLS else _in_passes(state, features, models, grow)
    drop(state)
    return Boosted(folds, depth, logistic, found, [trees[m] for m in models])
