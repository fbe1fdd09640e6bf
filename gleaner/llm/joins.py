"""A join whose keys may be very common on one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import stored

#: Keys that hold more than this share of the rows are joined apart; there are fewer of them than one over it.
SHARE = 1 / 5_000


def join_unique(rows: DataFrame, unique: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with a table that has each key once, and in column ``size`` how many rows the key has.

    Rows of a key that many share don't meet in one task: such keys, fewer than
    1 / SHARE by their definition, are broadcast; the others are joined by a
    shuffle in which no key is large.  Null keys match nothing.
    """
    total = unique.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) > max(total * SHARE, 1000)
    held = stored(unique.where(large).drop(size), "large-keys")
    if held.isEmpty():
        return rows.join(unique.drop(size), key)
    near = rows.join(F.broadcast(held), key)
    far = rows.join(F.broadcast(held.select(key)), key, "left_anti").join(unique.where(~large).drop(size), key)
    return near.unionByName(far)
