"""Equi join of a large, skewed side with one row per key, without a hot task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_join(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join on ``key``; ``per_key`` has one row per key, with the number ``count`` of its rows.

    Keys with more than a thousandth of all ``total`` rows, so fewer than a thousand keys, are broadcast
    and their rows aren't shuffled; the rest is joined by hash partition, where no key is hot.
    """
    limit = max(1, total // 1000)
    hot, rest = per_key.filter(F.col(count) > limit), per_key.filter(F.col(count) <= limit)
    many = rows.join(F.broadcast(hot), key)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest.hint("shuffle_hash"), key)
    return many.unionByName(few)
