"""Corpus statistics, sampling and synthetic labels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def token_frequency(tokens: DataFrame, term: str, order: str) -> DataFrame:
    """(term, n, raw, first_seen): occurrences, first raw form, and place of the first one."""
    return tokens.groupBy(term).agg(F.count("*").alias("n"), F.min_by("raw", order).alias("raw"), F.min(order).alias("first_seen"))


def top_terms(freq: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The n most frequent terms, first seen first among equals; within each of ``by`` if given."""
    order = [F.col("n").desc(), F.col("first_seen")]
    if not by:
        return freq.orderBy(*order).limit(n)
    return freq.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def buckets(text: Column, rules: dict[str, str], other: str = "other") -> Column:
    """All buckets whose pattern a text matches; ``other`` alone where none does."""
    hit = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(b)) for b, p in rules.items()]))
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit(other)))


def coverage(freq: DataFrame, covered: Column, noise: Column, n: str = "n") -> DataFrame:
    """(kind, terms, n, percent) of weighted coverage: covered, noise, unknown."""
    kind = F.when(covered, "covered").when(noise, "noise").otherwise("unknown")
    agg = freq.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("terms"), F.sum(n).alias("n"))
    total = agg.agg(F.sum("n").alias("_all"))
    return agg.join(F.broadcast(total)).withColumn("percent", F.when(F.col("_all") > 0, F.floor(F.col("n") / F.col("_all") * 1000 + 0.5) / 10)).drop("_all")


def first_of_sources(parts: list[DataFrame], term: str, n: str) -> DataFrame:
    """A corpus from several lists: of each term the value of the first list that has it."""
    all_ = reduce(lambda a, b: a.unionByName(b), [p.select(term, n, F.lit(i).alias("_src")) for i, p in enumerate(parts)])
    return all_.groupBy(term).agg(F.min_by(n, F.struct("_src", F.negative(n))).alias(n))


def uniform(seed: int, *cols: str) -> Column:
    """A repeatable number in (0, 1) from the values of columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def weighted_sample(df: DataFrame, weight: str, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows without replacement, with chances by weight (Efraimidis and Spirakis 2006)."""
    return df.filter(F.col(weight) > 0).withColumn("_k", -F.log(uniform(seed, *keys)) / F.col(weight)).orderBy("_k", *keys).limit(n).drop("_k")


def corrupted(text: Column, rate: Column, seed: Column, swaps: list[tuple[str, str]]) -> Column:
    """A text with one or two reading errors (a character swapped, lost or put in), with chance ``rate``, repeatable by seed."""
    table: dict[str, list[str]] = {}
    for a, b in swaps:
        table.setdefault(a, []).append(b)
    signs = sorted(table)

    @F.pandas_udf(StringType())
    def f(t: pd.Series, r: pd.Series, s: pd.Series) -> pd.Series:
        import random

        def one(x: str | None, p: float, k: int) -> str | None:
            rng = random.Random(int(k))
            if not x or rng.random() >= p:
                return x
            for _ in range(rng.randint(1, 2)):
                at = [i for i, c in enumerate(x) if c in table]
                kind = rng.random()
                i = rng.randrange(len(x))
                if at and kind < 0.6:
                    i = rng.choice(at)
                    x = x[:i] + rng.choice(table[x[i]]) + x[i + 1 :]
                elif kind < 0.8 and len(x) > 1:
                    x = x[:i] + x[i + 1 :]
                else:
                    x = x[:i] + rng.choice(signs or list(x)) + x[i:]
            return x

        return pd.Series([one(x, p, k) for x, p, k in zip(t, r, s, strict=True)], dtype="object")

    return f(text, rate, seed)


#: Parts into which the running sum of weights is cut.
CUTS = 1024


def drawn(terms: DataFrame, term: str, weight: str, draws: DataFrame, u: str) -> DataFrame:
    """``draws`` with the term whose stretch of the running sum of weights holds the place ``u``, a number in [0, 1).

    Terms fall into hash groups; the sums of these (CUTS of them) give the offset of each, so no task sums all weights. Stretches and
    draws meet in CUTS equal parts of the sum, where places are looked up by binary search; a heavy term stands in
    several parts, and all terms can be drawn, however many there are.
    """
    t = terms.filter(F.col(weight) > 0).select(term, F.col(weight).cast("double").alias("_w"), F.pmod(F.xxhash64(term), F.lit(CUTS)).cast("int").alias("_g"))
    sums = sorted(t.groupBy("_g").agg(F.sum("_w").alias("s")).collect())
    total = sum(r.s for r in sums)
    if not total:
        return draws.withColumn(term, F.lit(None).cast("string")).limit(0)
    start, offsets = 0.0, []
    for r in sums:
        offsets.append((r._g, start))
        start += r.s
    spark = terms.sparkSession
    placed = t.join(F.broadcast(spark.createDataFrame(offsets, "_g int, _o double")), "_g")
    upto = placed.withColumn("_z", (F.col("_o") + F.sum("_w").over(Window.partitionBy("_g").orderBy(term).rowsBetween(Window.unboundedPreceding, 0))) / total)
    a, z = F.col("_z") - F.col("_w") / total, F.col("_z")
    cut = F.sequence(F.greatest(F.floor(a * CUTS), F.lit(0)), F.least(F.floor(z * CUTS), F.lit(CUTS - 1)))
    stretches = upto.select(term, z.alias("_z"), F.explode(cut).alias("_cut"))
    asked = draws.withColumn("_cut", F.floor(F.col(u) * CUTS))
    names, schema = draws.columns, StructType([*draws.schema.fields, StructField(term, StringType())])

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        z = np.asarray(right.column("_z"))
        order = np.argsort(z, kind="stable")
        out = left.select(names)
        if not len(z):
            return out.slice(0, 0).append_column(term, pa.array([], pa.string()))
        at = order[np.minimum(np.searchsorted(z[order], np.asarray(left.column(u)), side="right"), len(z) - 1)]
        return out.append_column(term, right.column(term).combine_chunks().take(pa.array(at)))

    return asked.groupBy("_cut").cogroup(stretches.groupBy("_cut")).applyInArrow(look, schema)


def synthetic_labels(terms: DataFrame, term: str, weight: str, labels: DataFrame, label: str, least: int = 12, most: int = 25, seed: int = 1) -> DataFrame:
    """(label, text): labels of 12 to 25 terms drawn by weight, repeats within a label left out."""
    n = (F.pmod(F.xxhash64(label, F.lit(seed)), F.lit(most - least + 1)) + least).cast("int")
    draws = labels.select(label, F.explode(F.sequence(F.lit(1), n)).alias("_i")).withColumn("_u", uniform(seed, label, "_i"))
    got = drawn(terms, term, weight, draws, "_u").groupBy(label, term).agg(F.min("_i").alias("_i"))
    return got.groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", term))), lambda x: x[term]), "、").alias("text"))
