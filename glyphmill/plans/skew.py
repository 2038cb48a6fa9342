"""Joins that survive keys holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than 1 / HEAVY_KEYS of all rows, so there are fewer heavy keys than this.
HEAVY_KEYS = 2000


#: Tables of up to so many rows are broadcast where a plan asks for it.
SMALL_ROWS = 100_000


def if_small(df: DataFrame, counted: DataFrame | None = None, most: int = SMALL_ROWS) -> DataFrame:
    """`df` to be broadcast if it, or `counted`, which has as many rows or more, has `most` rows at most; else as it is."""
    return F.broadcast(df) if (df if counted is None else counted).limit(most + 1).count() <= most else df


def split_join(rows: DataFrame, keyed: DataFrame, on: Sequence[str], weight: str, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """Inner join of `rows` with `keyed`, which has one row per key and in `weight` the key's number of rows.

    The heavy keys, fewer than `heavy_keys`, are broadcast, and their rows stay where they are; all others are shuffled.
    `keyed` is read several times: cut its lineage first. Keys are compared by equality, a null key joins nothing.
    """
    on, total = list(on), keyed.agg(F.sum(weight)).first()[0] or 0
    limit = total / heavy_keys
    heavy = keyed.filter(F.col(weight) > limit).drop(weight)
    if heavy.isEmpty():
        return rows.join(keyed.drop(weight).hint("shuffle_hash"), on)
    light = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    rest = keyed.filter(F.col(weight) <= limit).drop(weight).hint("shuffle_hash")
    return rows.join(F.broadcast(heavy), on).unionByName(light.join(rest, on))
