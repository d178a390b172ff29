"""Nearest-value joins: move a prediction to the closest observed target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlake.operators.quantiles import ordered_parts
from featlake.session import settle


def nearest_values(points: DataFrame, refs: DataFrame, x: str, v: str, by: list[str] = (), out: str = "nearest") -> DataFrame:
    """For each distinct (by, x) the closest ``v`` of the same group; on a tie the smaller one.

    Both sides are reduced to distinct values and sorted into range partitions. Inside a partition a window finds the
    neighbours; a table with one line per partition and group supplies the ones further away. Groups without any
    reference value do not appear, nor do missing and NaN values.
    """
    by = list(by)
    known = lambda df, c: df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    pts = known(points, x).select(*by, F.col(x).cast("double").alias("_x"), F.lit(None).cast("double").alias("_v"))
    ref = known(refs, v).select(*by, F.col(v).cast("double").alias("_x"), F.col(v).cast("double").alias("_v"))
    both = (pts.unionByName(ref).dropna(subset=by) if by else pts.unionByName(ref)).groupBy(*by, "_x").agg(
        F.max("_v").alias("_v"), F.max(F.col("_v").isNull()).alias("_asked"))
    parts = ordered_parts(both, [*by, "_x"])
    grp = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    edges = (parts.groupBy(*by, "_part").agg(F.max("_v").alias("_top"), F.min("_v").alias("_low"))
             .withColumn("_prev", F.max("_top").over(grp.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("_next", F.min("_low").over(grp.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)))
             .select(*by, "_part", "_prev", "_next"))
    cell = Window.partitionBy(*by, "_part")
    upto = lambda o: cell.orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    rows = (parts.withColumn("_below", F.max("_v").over(upto(F.asc("_x"))))
            .withColumn("_above", F.min("_v").over(upto(F.desc("_x"))))
            .where("_asked").join(edges, [*by, "_part"]))
    below, above = F.coalesce("_below", "_prev"), F.coalesce("_above", "_next")
    pick = (F.when(below.isNull(), above).when(above.isNull(), below)
            .when(F.abs(F.col("_x") - below) <= F.abs(F.col("_x") - above), below).otherwise(above))
    return rows.select(*by, F.col("_x").alias(x), pick.alias(out)).where(F.col(out).isNotNull())


def snap_nearest(df: DataFrame, col: str, refs: DataFrame, ref_col: str, by: list[str] = (), out: str = "snapped") -> DataFrame:
    """Add the closest reference value of the row's group; the raw value where the group has none, and for NaN."""
    by = list(by)
    distinct = refs.select(*by, F.col(ref_col).cast("double").alias("_v")).distinct()
    look = settle(nearest_values(df, distinct, col, "_v", by, "_near").withColumnRenamed(col, "_x"))
    met = df.withColumn("_x", F.col(col).cast("double")).join(look, [*by, "_x"], "left")
    return met.select(*[F.col(c) for c in df.columns], F.coalesce("_near", "_x").alias(out))


def snap_and_mix(df: DataFrame, col: str, refs: DataFrame, ref_col: str, by: list[str] = (), weight: float = 0.4,
                 out: str = "final") -> DataFrame:
    """weight * snapped + (1 - weight) * raw."""
    s = snap_nearest(df, col, refs, ref_col, by, "_snap")
    return s.withColumn(out, F.lit(weight) * F.col("_snap") + F.lit(1 - weight) * F.col(col)).drop("_snap")
