"""Key joins between fact rows and keyed feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.session import settle


def enrich(df: DataFrame, dim: DataFrame, on: str | list[str], fill: dict | None = None, null_token: str | None = None) -> DataFrame:
    """Left join of a keyed feature table; rows without a match get null, or ``fill``.

    A computed ``dim`` is settled first: its measured size then decides between a broadcast and a
    shuffle join, and a hot key on the fact side can be split. ``null_token`` is the key under which
    ``dim`` holds the rows without a key; by default such rows match nothing.
    """
    on = [on] if isinstance(on, str) else list(on)
    dim = settle(dim)
    if null_token is None:
        out = df.join(dim, on, "left")
    else:
        keys = {c: f"_key_{c}" for c in on}
        left = df.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit(null_token)) for c, k in keys.items()})
        out = left.join(dim.withColumnsRenamed(keys), list(keys.values()), "left").drop(*keys.values())
    return out.fillna(fill) if fill else out


def lookup(df: DataFrame, dim: DataFrame, on: str | list[str], fill: dict | None = None) -> DataFrame:
    """Left join of a stored lookup table, whose file size the planner already knows."""
    out = df.join(dim, on, "left")
    return out.fillna(fill) if fill else out


def attach_side(df: DataFrame, side: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Left join of a side table whose key has another name; the side key is not kept."""
    return df.join(side.withColumnRenamed(right_on, left_on), left_on, "left")


def outer_merge(a: DataFrame, b: DataFrame, on: str | list[str]) -> DataFrame:
    """Full outer join with one merged key."""
    return a.join(b, on, "full_outer")


def map_lookup(df: DataFrame, col: str, mapping: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Replace each value of ``col`` by its entry in a two-column table; unknown values give null."""
    return df.join(mapping.select(F.col(key).alias(col), F.col(value).alias(out)), col, "left")


def join_all(frames: list[DataFrame], on: str | list[str], how: str = "left") -> DataFrame:
    """Join tables that share a unique key."""
    return reduce(lambda a, b: a.join(b, on, how), frames)


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in ``keys``; repeated keys are reduced map-side before they are joined."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(settle(keys.select(*on).distinct()), on, "left_semi")


def assemble(blocks: list[DataFrame], key: str) -> DataFrame:
    """Put feature blocks side by side by key; row order plays no part."""
    return join_all(blocks, key, "inner")
