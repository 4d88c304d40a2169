"""Edit-distance join without comparing all pairs.

A term with allowance k is cut into k + 1 even segments. A string within k edits of it holds at least one of
them unchanged, moved by at most k places. So the terms are exploded to (length, segment number,
segment), the strings to the substrings that could be one of these for every length within the allowance,
and the two meet in an equi join of hashes; survivors are verified with the built-in bounded distance. Only places
are tried that edits left and right of a segment can explain. This is complete: no pair within the allowance
is lost (segment filter with multi-match-aware selection of Li et al., PVLDB 2011).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import characters
from ..session import spread_small

#: (largest length, allowance) steps, and the allowance beyond them.
STEPS, BEYOND = ((2, 0), (4, 1), (7, 2)), 3


def allowance(n: Column, steps: tuple[tuple[int, int], ...] = STEPS, beyond: int = BEYOND) -> Column:
    """The edits allowed for a term of length n."""
    out = None
    for most, k in steps:
        out = F.when(n <= most, k) if out is None else out.when(n <= most, k)
    return out.otherwise(beyond)


def _segments(length: str, k: str) -> str:
    """SQL for the array of (number, start, size) of the even segments of a term."""
    base, long = f"({length} div ({k} + 1))", f"({length} % ({k} + 1))"
    first = f"({k} + 1 - {long})"
    size = f"({base} + if(i >= {first}, 1, 0))"
    start = f"(i * {base} + greatest(0, i - {first}) + 1)"
    return f"transform(sequence(0, {k}), i -> named_struct('i', i, 's', cast({start} as int), 'n', cast({size} as int)))"


def near_pairs(strings: DataFrame, terms: DataFrame, string: str, term: str, on: tuple[str, ...] = ()) -> DataFrame:
    """(on..., string, term, edits) of distinct strings and terms within the smaller of their allowances.

    ``on``: further columns that must be equal. Equal pairs are found with 0 edits. Nulls and empty
    strings pair with nothing. The two sides are alike but for the cost: a string is looked up at some forty places, a term is cut into four, so
    the larger side is better given as ``terms``.
    """
    keys = [F.col(c) for c in on]
    kt, ks = allowance(F.col("_tl")), allowance(F.col("_sl"))
    code = F.xxhash64(*keys, "_tl", "_i", "_part")
    t = terms.select(*keys, F.col(term).alias(term)).filter(F.length(term) > 0).distinct().withColumn("_tl", F.length(term)).withColumn("_k", kt).withColumn("_tb", F.explode(F.array(characters(F.col(term)))))
    t = t.withColumn("_seg", F.explode(F.expr(_segments("_tl", "_k")))).select(*keys, term, "_tb", "_tl", F.col("_seg.i").alias("_i"), F.substring(F.col(term), F.col("_seg.s"), F.col("_seg.n")).alias("_part"))
    t = t.select(*[k.alias(f"_t_{c}") for k, c in zip(keys, on, strict=True)], term, "_tb", code.alias("_code"))
    s = spread_small(strings.select(*keys, F.col(string).alias(string)).filter(F.length(string) > 0).distinct()).withColumn("_sl", F.length(string)).withColumn("_a", ks).withColumn("_sb", F.explode(F.array(characters(F.col(string)))))
    s = s.withColumn("_tl", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_sl") - F.col("_a")), F.col("_sl") + F.col("_a")))).withColumn("_k", kt).filter(F.abs(F.col("_tl") - F.col("_sl")) <= F.least("_a", "_k"))
    s = s.withColumn("_seg", F.explode(F.expr(_segments("_tl", "_k"))))
    # where an unchanged segment can be: at most as many places off as edits can stand to its left, and to its right
    i, d = F.col("_seg.i"), F.col("_sl") - F.col("_tl")
    lo = F.greatest(F.lit(1), F.col("_seg.s") - i, F.col("_seg.s") + d - (F.col("_k") - i))
    hi = F.least(F.col("_sl") - F.col("_seg.n") + 1, F.col("_seg.s") + i, F.col("_seg.s") + d + (F.col("_k") - i))
    s = s.withColumn("_at", F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).withColumn("_i", i)
    s = s.withColumn("_part", F.substring(F.col(string), F.col("_at"), F.col("_seg.n"))).select(*keys, string, "_sb", code.alias("_code"))
    # never broadcast: Spark takes an exploded side for as small as it was before, and would collect all of it to the driver
    met = s.hint("merge").join(t.hint("merge"), "_code")
    for c in on:
        met = met.filter(F.col(c) == F.col(f"_t_{c}"))
    # verified before repeats are dropped, so that only near pairs are shuffled; most share a short segment and too few characters
    met = met.select(*keys, string, term, "_sb", "_tb").withColumn("_m", F.least(allowance(F.length(string)), allowance(F.length(term))))
    near = met.withColumn("edits", F.expr(f"case when bit_count(_sb & ~_tb) > _m or bit_count(_tb & ~_sb) > _m then -1 when _m = 0 then if({string} = {term}, 0, -1) when _m = 1 then levenshtein({string}, {term}, 1) when _m = 2 then levenshtein({string}, {term}, 2) else levenshtein({string}, {term}, 3) end"))
    return near.filter("edits >= 0").select(*keys, string, term, "edits").distinct()
