"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.tables import LARGE_ROWS, discard, materialise, shared_dir, small_batches

__all__ = ["LARGE_ROWS", "attach", "cache_cleared_by", "claim", "discard", "each_text", "materialise", "shared_dir", "small_batches", "text_of"]

#: A key counts as hot when it holds over 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


_CACHES: dict[str, Callable[[], None]] = {}


def cache_cleared_by(name: str, clear: Callable[[], None]) -> None:
    """Registers what an operator keeps in a Python worker from task to task."""
    _CACHES[name] = clear


def claim(name: str) -> None:
    """Called by an operator's tasks: workers are used again, and what other operators kept in this one is let go."""
    for other, clear in _CACHES.items():
        if other != name:
            clear()
    pa.default_memory_pool().release_unused()


def each_text(column: pa.Array, rows: int = 64) -> Iterator[str]:
    """The texts of a batch's column, few of them as Python strings at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column) -> DataFrame:
    """Left join of rows to ``groups`` (a written table, one row per key) that hot keys do not slow.

    Keys that hold over 1/HOT_SHARE of all grouped rows, which are HOT_SHARE at most, are broadcast; the other keys
    meet in a shuffled join, where rows of hot keys are dealt by ``spread`` instead and match nothing.
    The join is on a string ``key``, which may not be null.
    """
    payload = [c for c in groups.columns if c != key]
    total = groups.agg(F.sum(size)).first()[0] or 0
    bound = max(total // HOT_SHARE, 1)
    hot = groups.filter(F.col(size) > bound).select(F.col(key).alias("_hot_key"), F.struct(*payload).alias("_hot"))
    cold = groups.filter(F.col(size) <= bound).select(F.col(key).alias("_cold_key"), F.struct(*payload).alias("_cold"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    dealt = F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(F.concat(F.lit("\0"), F.coalesce(spread.cast("string"), F.lit(""))))
    out = out.withColumn("_dealt", dealt).join(cold, F.col("_dealt") == F.col("_cold_key"), "left")
    found = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[found[c].alias(c) for c in payload])
