"""Exact means of the nearest neighbours (J14), by cells around pivots.

Equal points are one point: rows with the same features have the same neighbours, and of one point and fold no more than
k rows can be among the nearest. Every point belongs to the cell of its nearest pivot. A point first meets its own cell, which bounds
how far its k-th neighbour can be; then only the cells that the triangle inequality leaves within that bound. Cells are
cut into tiles, so neither a dense cell nor a hot point is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlake.operators.oof import fold_numbers
from featlake.session import settle

PIVOTS = 512  # bounds what is sent to every task
TILE = 4096   # rows of a cell that meet others in one task
BLOCK = 256   # points whose distances to a tile are held at once


def _matrix(column: pa.Array) -> np.ndarray:
    d = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, added up column by column, so that equal points are at 0 exactly."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i:i + 1] - b[None, :, i]) ** 2
    return out


def with_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``points`` with the number of the nearest pivot and the distance from it."""
    schema = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)
    names = points.columns
    at = names.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d2 = squared(_matrix(b.column(at)), pivots) if b.num_rows else np.zeros((0, 1))
            near = d2.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(np.sqrt(d2[np.arange(len(near)), near]))], [*names, "cell", "away"])

    return points.mapInArrow(run, f"{schema}, cell int, away double")


def _best(tile: pa.Table, k: int) -> pa.Table:
    """Of each query in ``tile`` (queries and references of one tile), the k nearest references of other folds; ties go to the smaller key."""
    is_query = tile.column("query").to_numpy(zero_copy_only=False)
    q, r = tile.filter(pa.array(is_query)), tile.filter(pa.array(~is_query)).sort_by("doc")
    out = {"point": [], "fold": [], "d2": [], "at": []}
    if q.num_rows and r.num_rows:
        x, y = _matrix(q.column("x").combine_chunks()), _matrix(r.column("x").combine_chunks())
        qf, rf, point = q.column("fold").to_numpy(), r.column("fold").to_numpy(), q.column("point").to_numpy()
        for s in range(0, len(x), BLOCK):
            d2 = squared(x[s:s + BLOCK], y)
            d2[qf[s:s + BLOCK, None] == rf[None, :]] = np.inf
            for i, row in enumerate(d2, s):
                limit = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
                some = np.flatnonzero(row <= limit) if np.isfinite(limit) else np.flatnonzero(np.isfinite(row))
                some = some[np.argsort(row[some], kind="stable")][:k]
                out["point"].append(np.full(len(some), point[i]))
                out["fold"].append(np.full(len(some), qf[i]))
                out["d2"].append(row[some])
                out["at"].append(some)
    cols = {c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}
    at = pa.array(cols["at"].astype(np.int64))
    return pa.table({"point": pa.array(cols["point"].astype(np.int64)), "fold": pa.array(cols["fold"].astype(np.int32)), "d2": pa.array(cols["d2"].astype(float)),
                     "doc": r.column("doc").take(at), "y": r.column("y").take(at)})


def _search(queries: DataFrame, refs: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(point, fold, d2, doc, y): for each query (point, fold, x, cell) the k nearest rows of ``refs`` in that cell."""
    kind = dict(refs.dtypes)["doc"]
    blank = {"doc": F.lit(None).cast(kind), "y": F.lit(None).cast("double")}
    asked = queries.join(sizes, "cell").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    part = F.pmod(F.col("point"), F.greatest(F.lit(1), F.ceil(F.col("asked") / TILE))).cast("int")
    asked = asked.select("cell", "tile", part.alias("part"), F.lit(True).alias("query"), "point", "fold", "x", *[v.alias(c) for c, v in blank.items()])
    held = refs.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), (F.greatest(F.lit(1), F.ceil(F.col("asked") / TILE)) - 1).cast("int"))))
    held = held.select("cell", F.pmod(F.xxhash64("doc"), "tiles").cast("int").alias("tile"), "part", F.lit(False).alias("query"), F.lit(0).cast("long").alias("point"), "fold", "x", "doc", "y")
    names = ["query", "point", "fold", "x", "doc", "y"]

    def run(tile: pa.Table) -> pa.Table:
        return _best(tile.select(names), k)

    return asked.unionByName(held).groupBy("cell", "tile", "part").applyInArrow(run, f"point long, fold int, d2 double, doc {kind}, y double")


def _first(df: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; Spark cuts every partition to k rows of a query before it shuffles."""
    w = Window.partitionBy("point", "fold").orderBy("d2", "doc")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def knn_oof(df: DataFrame, doc: str, cols: list[str], y: str, fold: str, k: int = 15, out: str = "knn", pivots: int = PIVOTS) -> DataFrame:
    """``df`` with the mean target of the k rows of other folds that are nearest by Euclidean distance over ``cols``.

    Rows without a fold get the mean over the fold models, each of which leaves one fold out. Ties at the k-th distance go to the smaller ``doc``, a unique
    key. Rows without a fold or a target are nobody's neighbours; a row that lacks a feature is neither and gets null, as do
    rows without any neighbour. Fewer than k rows: the mean of those there are.
    """
    x = F.array(*[F.col(c).cast("double") for c in cols])
    full = df.where(~F.exists(x, lambda v: v.isNull() | F.isnan(v))).select(F.col(doc).alias("doc"), F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), x.alias("x"))
    full = settle(full.withColumn("x", F.transform("x", lambda v: v + 0.0)))
    points = settle(full.select("x").distinct().withColumn("point", F.monotonically_increasing_id()))
    rows = settle(full.join(points, "x"))
    folds = fold_numbers(rows, "fold")
    nothing = df.withColumn(out, F.lit(None).cast("double"))
    known = rows.where("fold is not null and y is not null")
    wanted = max(1, min(pivots, known.count() // (4 * k)))  # cells of a few times k rows, as far as PIVOTS allows
    centres = [r["x"] for r in known.select("x").distinct().orderBy(F.xxhash64("x", F.lit(7))).limit(wanted).collect()]
    if not centres:
        return nothing
    pivot = np.array(centres)
    few = Window.partitionBy("point", "fold").orderBy("doc")  # no more than k rows of one point and fold can matter
    refs = settle(with_cells(known.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= k).select("doc", "y", "fold", "x"), pivot))
    asked = rows.select("point", "x", F.explode(F.when(F.col("fold").isNull(), F.array(*[F.lit(f) for f in folds])).otherwise(F.array("fold"))).alias("fold")).distinct()
    asked = settle(with_cells(asked, pivot))
    shape = refs.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("far"))
    shape = settle(shape.join(asked.groupBy("cell").agg(F.count("*").alias("asked")), "cell", "left")
                   .select("cell", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), "far", F.coalesce("asked", F.lit(1)).alias("asked")))
    sizes = shape.select("cell", "tiles", "asked")
    near = settle(_first(_search(asked.select("point", "fold", "x", "cell"), refs, sizes, k), k))
    bound = near.groupBy("point", "fold").agg(F.count("*").alias("n"), F.sqrt(F.max("d2")).alias("bound")).where(F.col("n") == k).select("point", "fold", "bound")
    open_ = settle(asked.join(bound, ["point", "fold"], "left").select("point", "fold", "x", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound")))
    radius, held = np.full(len(pivot), -np.inf), np.zeros((len(pivot), len(folds)))
    for r in refs.groupBy("cell", "fold").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect():  # two numbers for each pivot and fold
        radius[r["cell"]] = max(radius[r["cell"]], r["far"])
        held[r["cell"], folds.index(r["fold"])] = r["n"]
    usable = held.sum(axis=1, keepdims=True) - held  # rows of a cell that are not of the fold
    place = {f: i for i, f in enumerate(folds)}
    schema = "point long, fold int, x array<double>, cell int"

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 2_000):
                b = whole.slice(s, 2_000)
                away = np.sqrt(squared(_matrix(b.column(2)), pivot))
                own, limit = b.column(3).to_numpy(), b.column(4).to_numpy()
                slack = 1e-9 * (1 + away)
                # the first cells that hold k usable rows among them bound the k-th distance by their far ends
                ends = np.where(np.isfinite(radius), away + radius, np.inf)
                order = np.argsort(ends, axis=1)
                enough = np.take_along_axis(usable[:, [place[f] for f in b.column(1).to_pylist()]].T, order, 1).cumsum(axis=1) >= k
                far = np.take_along_axis(ends, order, 1)[np.arange(len(own)), enough.argmax(axis=1)]
                limit = np.minimum(limit, np.where(enough.any(axis=1), far, np.inf))
                hit = away - radius[None, :] <= limit[:, None] + slack
                hit &= (away - away[np.arange(len(own)), own][:, None]) / 2 <= limit[:, None] + slack  # a cell's points are nearer to its pivot
                hit[np.arange(len(own)), own] = False
                i, cell = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(i)) for c in range(3)] + [pa.array(cell.astype(np.int32))], ["point", "fold", "x", "cell"])

    more = settle(open_.mapInArrow(others, schema))
    load = more.groupBy("cell").agg(F.count("*").alias("asked"))
    again = _search(more, refs, settle(shape.select("cell", "tiles").join(load, "cell")), k)
    best = _first(near.unionByName(again), k).groupBy("point", "fold").agg(F.avg("y").alias("v"))
    ask = rows.select("doc", "point", F.explode(F.when(F.col("fold").isNull(), F.array(*[F.lit(f) for f in folds])).otherwise(F.array("fold"))).alias("fold"))
    mean = ask.join(settle(best), ["point", "fold"]).groupBy("doc").agg(F.avg("v").alias(out))
    return df.join(mean.withColumnRenamed("doc", "_d"), F.col(doc) == F.col("_d"), "left").drop("_d")
