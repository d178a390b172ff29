"""Sums of products of many columns: matrix products of Arrow batches, put together place by place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 4_096  # rows multiplied at once


def summed(df: DataFrame, cols: list[str], fn: Callable[[np.ndarray], np.ndarray], by: str | None = None) -> DataFrame:
    """((by,) at, v): sums, over the rows (of each value of ``by``), of the numbers that ``fn`` makes of blocks of rows.

    ``fn`` gets a matrix of the columns as doubles, nulls as NaN, and returns an array of fixed length. A task hands on one array for each value of ``by``, of
    which there must be few; the plan does not grow with the number of columns.
    """
    kind = dict(df.dtypes)[by] if by else "int"
    key = F.col(by) if by else F.lit(0)
    read = df.select(key.alias("by"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        kind = pa.null()
        for whole in batches:
            kind = whole.schema.field(0).type
            for s in range(0, whole.num_rows, ROWS):
                b = whole.slice(s, ROWS)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, len(cols))
                code = b.column(0).dictionary_encode(null_encoding="encode")
                which = code.indices.to_numpy()
                for i, value in enumerate(code.dictionary.to_pylist()):
                    got = fn(x[which == i])
                    total[value] = total[value] + got if value in total else got
        for value, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([value] * len(v), kind), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["by", "at", "v"])

    return read.mapInArrow(run, f"by {kind}, at int, v double").groupBy("by", "at").agg(F.sum("v").alias("v"))


def gathered(df: DataFrame, by: str) -> DataFrame:
    """The numbers of :func:`summed` as one array ``v`` for each value of ``by``."""
    return df.groupBy(F.col("by").alias(by)).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("v"))
