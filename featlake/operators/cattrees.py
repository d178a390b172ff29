"""Regression trees on categories (J4): any number of values, no one-hot columns and no bins.

In a node the values of a column are ordered by their smoothed mean target; for squared error the best way to part them in two is a cut in the order
of means, so prefix sums over the order score all cuts. A level of all fold models is a few aggregates and joins over the combinations of values,
with the number and the sum of the targets of their rows; the rows themselves are met before the first level and after the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.functions.numeric import clip
from featlake.operators.oof import fold_numbers
from featlake.operators.quantiles import prefix_sums
from featlake.session import drop, settle


def best_cuts(counts: DataFrame) -> DataFrame:
    """(m, node, f, cut, heavy): the best split of each node from (m, node, f, o, n, s) with the values' order ``o``.

    Values from ``cut`` on go right; ``heavy`` is the side with more rows, where values go that the node has not seen. Ties go to the first
    column and the earliest cut. A node without a cut that lowers the error is missing.
    """
    keys = ["m", "node", "f"]
    a = prefix_sums(counts, keys, "o", "n", "bn", total="tn")
    both = prefix_sums(a, keys, "o", "s", "bs", total="ts").where("bn > 0")
    rest_n, rest_s = F.col("tn") - F.col("bn"), F.col("ts") - F.col("bs")
    gain = F.round(F.col("bs") * F.col("bs") / F.col("bn") + rest_s * rest_s / rest_n - F.col("ts") * F.col("ts") / F.col("tn"), 9)
    best = both.withColumn("gain", gain).where("gain > 0").groupBy("m", "node").agg(
        F.min(F.struct((-F.col("gain")).alias("less"), "f", F.col("o").alias("cut"), (rest_n > F.col("bn")).cast("int").alias("heavy"))).alias("b"))
    return best.select("m", "node", "b.f", "b.cut", "b.heavy")


def category_tree_oof(df: DataFrame, doc: str, cols: list[str], y: str, fold: str, depth: int = 4, smooth: float = 10.0, out: str = "prediction",
                      bounds: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """``df`` with the prediction of the tree that left the row's fold out; rows without a fold get the mean of all.

    A value's mean is drawn to its node's by ``smooth`` rows, which only matters for the order. Missing values are a value of their own. Rows without a target are only
    predicted; without any row to learn from the prediction is null.
    """
    cs = [f"c{i}" for i in range(len(cols))]
    rows = settle(df.select(F.col(doc).alias("d"), F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"),
                            *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"c{i}") for i, c in enumerate(cols)]))
    folds = fold_numbers(rows.where("y is not null"), "fold")
    if not folds:
        return df.withColumn(out, F.lit(None).cast("double"))
    cells = rows.groupBy("fold", *cs).agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("s"))
    learn = F.coalesce((F.col("fold") != F.col("m")) & (F.col("n") > 0), F.lit(False))
    now = cells.withColumn("m", F.explode(F.array(*[F.lit(f) for f in folds]))).withColumn("learn", learn)
    own = F.col("learn") | F.col("fold").isNull() | (F.col("fold") == F.col("m"))
    now = settle(now.where(own).withColumns({"node": F.lit(0), "value": F.lit(None).cast("double")}))
    value_of = F.element_at(F.array(*[F.col(c) for c in cs]), F.col("f") + 1)
    for level in range(depth + 1):
        mean = settle(now.where("learn").groupBy("m", "node").agg((F.sum("s") / F.sum("n")).alias("mean")))
        before, now = now, settle(now.join(mean, ["m", "node"], "left").withColumn("value", F.coalesce("mean", "value")).drop("mean"))
        drop(before)
        if level == depth:
            break
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("v")) for i, c in enumerate(cs)]))
        counts = now.where("learn").select("m", "node", "n", "s", each.alias("e")).groupBy("m", "node", "e.f", "e.v").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        order = F.struct(F.round((F.col("s") + smooth * F.col("mean")) / (F.col("n") + smooth), 9).alias("t"), "v")
        counts = settle(counts.join(mean, ["m", "node"]).select("m", "node", "f", order.alias("o"), "n", "s"))
        cuts = settle(best_cuts(counts))
        if cuts.isEmpty():
            break
        sides = settle(counts.join(cuts, ["m", "node", "f"]).select("m", "node", F.col("o.v").alias("at"), (F.col("o") >= F.col("cut")).cast("int").alias("right")))
        moved = now.join(cuts.select("m", "node", "f", "heavy"), ["m", "node"], "left").withColumn("at", value_of).join(sides, ["m", "node", "at"], "left")
        to = F.when(F.col("f").isNotNull(), F.col("node") * 2 + 1 + F.coalesce("right", "heavy")).otherwise(F.col("node"))
        # a node that is not split keeps its number, which no other node of a later level has
        before, now = now, settle(moved.withColumn("node", to).select("fold", *cs, "n", "s", "m", "learn", "node", "value"))
        for old in (before, mean, counts, cuts, sides):
            drop(old)
    own = clip(F.col("value"), *bounds) if bounds else F.col("value")
    guess = settle(now.where("not learn").groupBy(F.col("fold").alias("_fold"), *cs).agg(F.sum(own).alias("total"), F.count(own).alias("models")))
    got = (rows.join(guess, [*[rows[c] == guess[c] for c in cs], rows["fold"].eqNullSafe(guess["_fold"])])
           .groupBy("d").agg(F.try_divide(F.sum("total"), F.sum("models")).alias(out)))
    return df.join(got, F.col(doc) == F.col("d"), "left").drop("d")
