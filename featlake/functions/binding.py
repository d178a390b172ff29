"""Evaluate a costly expression once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time per row.

    An expression named inside a lambda would otherwise run again for every element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
