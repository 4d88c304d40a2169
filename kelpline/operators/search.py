"""Ranked search in the dictionaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 30


def limit_of(value: float | None) -> int:
    """A usable result limit: the default for missing, non-finite and non-positive values, else its floor."""
    if value is None or not math.isfinite(value) or value < 1:
        return LIMIT
    return math.floor(value)


def layer_of(id_: Column) -> Column:
    """The layer an entry id belongs to, by its prefix."""
    return F.when(id_.startswith("rule:"), "rule").when(id_.startswith("ing-"), "curated").otherwise("catalog")


def shown_status(id_: Column, status: Column) -> Column:
    """Catalogue entries are always shown as unknown."""
    return F.when(layer_of(id_) == "catalog", "unknown").otherwise(status)


def prefix_hits(terms: DataFrame, query: str, seen: DataFrame | None = None) -> DataFrame:
    """Entries with a term that begins with the query, without being it.

    The first such alias in the order of the dictionary stands for the entry; hits are sorted by its length and
    then by code point.
    """
    hit = terms.filter(F.col("term").startswith(query) & (F.col("term") != query))
    if seen is not None:
        hit = hit.join(seen.select("id").distinct(), "id", "left_anti")
    one = hit.groupBy("id").agg(F.min_by(F.struct("term", "alias", "status"), F.struct("ord", "alias_no")).alias("h"))
    return one.select("id", "h.*", F.length("h.term").alias("size"))


def searched(exact: DataFrame, prefixes: DataFrame, limit: float | None = None) -> DataFrame:
    """Exact rows, then prefix rows, cut at the limit (a top-k report), with the uncut total.

    Both have (id, term, status); at most one page of rows is ranked at the end.
    """
    n = limit_of(limit)
    a = exact.select(F.lit(0).alias("branch"), "id", "term", "status", F.length("term").alias("size"))
    b = prefixes.select(F.lit(1).alias("branch"), "id", "term", "status", "size")
    both = a.unionByName(b)
    total = both.agg(F.count("*").alias("total"))
    page = both.orderBy("branch", "size", "term", "id").limit(n)
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy("branch", "size", "term", "id")))
    return ranked.join(F.broadcast(total)).withColumn("truncated", F.col("total") > n).select("rank", "id", "term", shown_status(F.col("id"), F.col("status")).alias("status"), "total", "truncated")


def display_order(rows: DataFrame, label: str, preview: int = 8, order: tuple[str, ...] = ("haram", "syubhat", "unknown", "halal")) -> DataFrame:
    """Findings of each label by strictness, then score; the first ``preview`` and how many more there are."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("status")), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    w = Window.partitionBy(label)
    ranked = rows.withColumn("place", F.row_number().over(w.orderBy(rank, F.col("score").desc_nulls_last(), "ord"))).withColumn("n", F.count("*").over(w))
    return ranked.filter(F.col("place") <= preview).withColumn("more", F.greatest(F.col("n") - preview, F.lit(0))).drop("n")
