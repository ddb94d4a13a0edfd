"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1_000
# Rows of one key that a single task can take easily: with a vector in each row, and with a few numbers only.
HOT_ROWS = 200_000
HOT_NARROW_ROWS = 2_000_000


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    rows: str,
    total: int | None = None,
    hot_rows: int = HOT_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Inner join of `left` with `right`, where `right` has one row per key and `rows` counts the left rows of it.

    At most `hot_keys` keys with at least `hot_rows` rows are joined by broadcast, so their rows are never
    shuffled to one task. Any other key holds less than 1/`hot_keys` of the rows and is joined by shuffle.
    If `left` is known to have fewer than `hot_rows` rows in `total`, no key can be hot and one join does.
    """
    if total is not None and total < hot_rows:
        return left.join(right.drop(rows), key)
    hot = right.where(F.col(rows) >= hot_rows).orderBy(F.desc(rows), key).limit(hot_keys)
    hot_only = hot.select(key)
    by_broadcast = left.join(F.broadcast(hot), key)
    by_shuffle = left.join(F.broadcast(hot_only), key, "left_anti").join(
        right.join(F.broadcast(hot_only), key, "left_anti"), key
    )
    return by_broadcast.unionByName(by_shuffle).drop(rows)
