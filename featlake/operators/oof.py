"""Out-of-fold predictors: ridge from per-fold sums, and any Spark ML estimator over hash folds."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.functions.numeric import clip, exp_shift, log_shift
from featlake.operators.blocks import gathered, summed
from featlake.operators.boosted import Boosted, boosted_models
from featlake.operators.ordering import global_index
from featlake.operators.ranks import label_encode
from featlake.session import busy, dealt, settle


def fold_numbers(df: DataFrame, fold: str) -> list[int]:
    """The fold ids, one per fold."""
    return sorted(r[0] for r in df.where(F.col(fold).isNotNull()).select(fold).distinct().collect())


# ---- ridge regression from sums ----

def gram_sums(df: DataFrame, cols: list[str], y: str, fold: str) -> DataFrame:
    """Per fold: row count, sums of every column and of every product of two columns; the target counts as a column.

    Result: fold, n, s (sums) and g (upper triangle by rows), all from one pass.
    """
    full = [*cols, y]
    p = len(full)
    pairs = np.triu_indices(p)

    def sums(x: np.ndarray) -> np.ndarray:
        x = x[~np.isnan(x).any(axis=1)]
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x)[pairs]])

    got = gathered(summed(df, full, sums, fold), fold)
    return got.select(fold, F.col("v")[0].cast("long").alias("n"), F.slice("v", 2, p).alias("s"), F.slice("v", p + 2, len(pairs[0])).alias("g")).where("n > 0")


def _solve(n: float, s: np.ndarray, g: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients and, last, the intercept, which is not penalised."""
    mean = s / n
    cov = g - n * np.outer(mean, mean)
    p = len(s) - 1
    w = np.linalg.lstsq(cov[:p, :p] + alpha * np.eye(p), cov[:p, p], rcond=None)[0]
    return np.append(w, mean[p] - w @ mean[:p])


def ridge_models(df: DataFrame, cols: list[str], y: str, fold: str, alpha: float) -> dict[int, np.ndarray]:
    """Model per fold, learned on all other folds: total sums less the fold's own. One small row per fold is fetched."""
    p = len(cols) + 1
    parts = {}
    for r in gram_sums(df.where(F.col(fold).isNotNull()), cols, y, fold).collect():
        g = np.zeros((p, p))
        g[np.triu_indices(p)] = r["g"]
        parts[r[fold]] = (r["n"], np.array(r["s"]), g + np.triu(g, 1).T)
    n, s, g = (sum(v[i] for v in parts.values()) for i in range(3))
    return {f: _solve(n - v[0], s - v[1], g - v[2], alpha) for f, v in sorted(parts.items())}


def linear_score(cols: list[str], model: np.ndarray) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * float(w) for c, w in zip(cols, model)], F.lit(float(model[-1])))


def ridge_oof(df: DataFrame, cols: list[str], y: str, fold: str, alpha: float = 20.0, out: str = "prediction",
              test: DataFrame | None = None, bounds: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """Out-of-fold ridge predictions; ``test`` rows, and rows without a fold, get the mean of the fold models.

    A row with a missing feature gets a null prediction.
    """
    models = ridge_models(df, cols, y, fold, alpha)
    lim = (lambda c: clip(c, *bounds)) if bounds else (lambda c: c)
    mean = reduce(lambda a, b: a + b, [lim(linear_score(cols, m)) for m in models.values()]) / len(models)
    own = reduce(lambda acc, f: acc.when(F.col(fold) == f, lim(linear_score(cols, models[f]))), models, F.when(F.col(fold).isNull(), mean))
    res = df.withColumn(out, own)
    if test is None:
        return res
    return res.unionByName(test.withColumn(out, mean), allowMissingColumns=True)


def predict_missing(df: DataFrame, cols: list[str], value: str, fold: str, alpha: float = 20.0, out: str = "value_pred") -> DataFrame:
    """Predict the log of a partly missing value; add the prediction and its distance from the known value (0 if missing)."""
    known = df.where(F.col(value).isNotNull()).withColumn("_y", log_shift(F.col(value), 0.0001))
    unknown = df.where(F.col(value).isNull())
    both = ridge_oof(known, cols, "_y", fold, alpha, "_log", test=unknown, bounds=None)
    return (both.withColumn(out, exp_shift(F.col("_log"), 0.0001))
            .withColumn(f"{out}_diff", F.coalesce(F.col(out) - F.col(value), F.lit(0.0))).drop("_y", "_log"))


# ---- any Spark ML estimator ----

def assemble_features(df: DataFrame, cols: list[str], keep: list[str], out: str = "features") -> DataFrame:
    """One vector column at the edge to the model; missing values count as 0."""
    filled = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    return VectorAssembler(inputCols=cols, outputCol=out).transform(filled).select(*keep, out)


def _scored(model, df: DataFrame, out: str, probability: bool) -> DataFrame:
    col = vector_to_array("probability")[1] if probability else F.col("prediction").cast("double")
    res = model.transform(df).withColumn(out, col)
    return res.select(*df.columns, out)


def oof_predict(estimator: Estimator, train: DataFrame, fold: str, test: DataFrame | None = None, label: str = "label",
                out: str = "oof", bounds: tuple[float, float] | None = (0.0, 1.0), probability: bool = False) -> DataFrame:
    """Fit on all folds but one, predict that one; test rows, and rows without a fold, get the mean of the fold models.

    ``train`` is settled, so that the fits do not recompute the features. Where its rows lie in too few partitions for the cores, the folds are
    fitted side by side.
    """
    train = settle(train)
    loose = train.where(F.col(fold).isNull())
    rest = loose if test is None else loose.unionByName(test, allowMissingColumns=True)
    parts, scored_test, names = [], dealt(settle(rest)), []
    folds, spark = fold_numbers(train, fold), train.sparkSession
    fit = inheritable_thread_target(spark)(lambda f: estimator.copy().fit(train.where(F.col(fold) != f)))
    few = 2 * busy(train) < spark.sparkContext.defaultParallelism
    with ThreadPool(max(1, len(folds)) if few else 1) as pool:
        models = pool.map(fit, folds, 1)
    for f, model in zip(folds, models):
        parts.append(_scored(model, train.where(F.col(fold) == f), out, probability))
        names.append(f"_p{f}")
        scored_test = _scored(model, scored_test, names[-1], probability)
    res = reduce(lambda a, b: a.unionByName(b), parts)
    mean = reduce(lambda a, b: a + b, [F.col(c) for c in names]) / len(names)
    res = res.unionByName(scored_test.withColumn(out, mean).drop(*names), allowMissingColumns=True)
    return res.withColumn(out, clip(F.col(out), *bounds)) if bounds else res


def linear_oof(train: DataFrame, fold: str, test: DataFrame | None = None, reg: float = 0.001, l1_share: float = 0.5, **kw) -> DataFrame:
    return oof_predict(LinearRegression(regParam=reg, elasticNetParam=l1_share), train, fold, test, **kw)


def fm_oof(train: DataFrame, fold: str, test: DataFrame | None = None, factors: int = 4, iters: int = 20, seed: int = 1, **kw) -> DataFrame:
    return oof_predict(FMRegressor(factorSize=factors, maxIter=iters, seed=seed, stepSize=0.05), train, fold, test, **kw)


def _boosted_rows(models: Boosted, train: DataFrame, fold: str, test: DataFrame | None, out: str, bounds: tuple[float, float] | None, seed: int = 0) -> DataFrame:
    """``train`` and ``test`` with the value of each row's model."""
    value = lambda f: clip(models.predicted("features", f, seed), *bounds) if bounds else models.predicted("features", f, seed)
    scored = dealt(train).withColumn(out, value(F.col(fold)))
    return scored if test is None else scored.unionByName(dealt(settle(test)).withColumn(out, value(F.lit(None).cast("int"))), allowMissingColumns=True)


def _boosted_oof(est: Estimator, train: DataFrame, fold: str, test: DataFrame | None, label: str = "label", out: str = "oof",
                 bounds: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """As :func:`oof_predict` with boosted trees; features that are marked as categories are left to Spark ML."""
    train = settle(train)
    models = boosted_models([est], train, fold, fold_numbers(train, fold), label)
    if models is None:
        return oof_predict(est, train, fold, test, label, out, bounds, probability=isinstance(est, GBTClassifier))
    return _boosted_rows(models, train, fold, test, out, bounds)


def gbt_oof(train: DataFrame, fold: str, test: DataFrame | None = None, trees: int = 20, depth: int = 5, seed: int = 1, **kw) -> DataFrame:
    return _boosted_oof(GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed), train, fold, test, **kw)


def boosted_oof(train: DataFrame, fold: str, test: DataFrame | None = None, most: int = 200, gain: float = 0.001, depth: int = 5, seed: int = 1,
                out: str = "oof", bounds: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """Boosted trees that stop by the left-out fold: (columns, ``out``, rounds).

    A fold's model stops when its error on the left-out fold no longer falls by ``gain`` of itself (0.01 at least), and keeps the trees up to its least error;
    ``rounds`` is their number, for test rows and rows without a fold the sum over the models, whose mean they get.
    """
    train = settle(train)
    folds = fold_numbers(train, fold)
    if not folds:
        return train.withColumns({out: F.lit(None).cast("double"), "rounds": F.lit(0)})
    est = GBTRegressor(maxIter=most, maxDepth=depth, seed=seed)
    models = boosted_models([est], train, fold, folds, gain=gain)
    if models is None:
        raise ValueError("features that are marked as categories are not supported")
    each = {f: len(t.feature) for f, t in zip(folds, models.trees)}
    own = reduce(lambda acc, f: acc.when(F.col("_own") == f, each[f]), folds, F.when(F.col("_own").isNull(), sum(each.values())))
    train = train.withColumn("_own", F.col(fold))
    test = None if test is None else test.withColumn("_own", F.lit(None).cast(dict(train.dtypes)["_own"]))
    return _boosted_rows(models, train, fold, test, out, bounds).withColumn("rounds", own).drop("_own")


def forest_oof(train: DataFrame, fold: str, test: DataFrame | None = None, trees: int = 100, depth: int = 8, seed: int = 1, **kw) -> DataFrame:
    """Rows of a large table are dealt over all cores first; the rows that a tree draws follow from the partitions."""
    return oof_predict(RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed), dealt(settle(train), 50_000), fold, test, **kw)


def classify_oof(train: DataFrame, fold: str, test: DataFrame | None = None, kind: str = "logistic", trees: int = 20, **kw) -> DataFrame:
    """Probability of class 1 of a 0/1 label."""
    if kind != "logistic":
        return _boosted_oof(GBTClassifier(maxIter=trees, seed=1), train, fold, test, **kw)
    return oof_predict(LogisticRegression(regParam=0.01), train, fold, test, probability=True, **kw)


def onehot_oof(df: DataFrame, cols: list[str], keep: list[str], fold: str, test: DataFrame | None = None,
               estimator: Estimator | None = None, **kw) -> DataFrame:
    """Label codes, sparse one-hot vectors, then an out-of-fold model; train and test share the codes."""
    marked = df.withColumn("_test", F.lit(False))
    if test is not None:
        marked = marked.unionByName(test.withColumn("_test", F.lit(True)), allowMissingColumns=True)
    coded = settle(label_encode(marked, cols).select("_test", *keep, *[F.col(c).cast("double").alias(c) for c in cols]))
    enc = Pipeline(stages=[OneHotEncoder(inputCols=cols, outputCols=[f"_o_{c}" for c in cols], dropLast=False),
                           VectorAssembler(inputCols=[f"_o_{c}" for c in cols], outputCol="features")])
    vecs = enc.fit(coded).transform(coded).select("_test", *keep, "features")
    est = estimator or LinearRegression(regParam=0.001)
    return oof_predict(est, vecs.where("NOT _test").drop("_test"), fold,
                       None if test is None else vecs.where("_test").drop("_test"), **kw)


def half_oof(df: DataFrame, order: str, cols: list[str], y: str, alpha: float = 5.0, test: DataFrame | None = None, out: str = "prediction") -> DataFrame:
    """Two ordered halves predict each other; test rows get the mean of both models."""
    n = df.agg(F.count(F.lit(1))).scalar()
    halves = settle(global_index(df, [order], "_i").withColumn("_half", (F.col("_i") * 2 >= n).cast("int")).drop("_i"))
    return ridge_oof(halves, cols, y, "_half", alpha, out, test).drop("_half")


def seed_average(train: DataFrame, fold: str, seeds: list[int], key: str, test: DataFrame | None = None, out: str = "oof",
                 trees: int = 20, depth: int = 5, bounds: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """Mean of the predictions of the same model under several seeds: out of fold for train rows, fold means for test rows.

    The models of all seeds grow together, from one pass over the rows.
    """
    train = settle(train)
    ests = [GBTRegressor(maxIter=trees, maxDepth=depth, seed=s) for s in seeds]
    models = boosted_models(ests, train, fold, fold_numbers(train, fold))
    if models is None:
        runs = [gbt_oof(train, fold, test, trees, depth, s, out=out, bounds=bounds) for s in seeds]
    else:
        runs = [_boosted_rows(models, train, fold, test, out, bounds, i) for i in range(len(seeds))]
    return reduce(lambda a, b: a.unionByName(b), [r.select(key, out) for r in runs]).groupBy(key).agg(F.avg(out).alias(out))
