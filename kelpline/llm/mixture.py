"""Mixing sources to target weights, sizes in tokens of a public tokenizer.

``water_fill`` clamps every source at the tokens it can give (its tokens times its repeat cap) and hands
the excess to the others in proportion to their weights until nothing is clamped anew. Every source then
needs r repetitions of each record on average: every record is used floor(r) times, and those first
in a seeded order once more until the fraction is filled. The place in that order is decided in two
distributed steps: token sums of 4096 hash slots a source find the slot in which the source fills up, sums of 4096 finer
slots the place inside it; only the records of that finer slot, one in 16 million, are ordered, so that a source
misses its tokens by less than one record.

With total ``all`` the mixture has as many tokens as the sources with a target have, so that small sources reach their caps, are
clamped there, and the others fill up. Without a total it is the largest one in which no source that has records falls short of
its share. Sources without a token give nothing and their share is spread over the others. The report names the clamped ones.

Defined results: records of sources without a target, with null source, or without a token aren't
used; null and non-positive shares and caps count as 0; target sources that occur twice are summed;
an empty table gives an empty mixture and a report of zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .encode import token_sizes

SLOTS = 4096


def water_fill(share: dict[str, float], most: dict[str, float], total: float | None = None) -> dict[str, float]:
    """Tokens each source gives: its share of ``total``, at most ``most``; excess spread in proportion."""
    open_ = {s for s in share if share[s] > 0 and most.get(s, 0) > 0}
    weight = sum(share[s] for s in open_)
    if not open_:
        return {s: 0.0 for s in share}
    if total is None:
        total = min(most[s] * weight / share[s] for s in open_)
    give = {s: 0.0 for s in share}
    left = float(total)
    while open_ and left > 0:
        weight = sum(share[s] for s in open_)
        over = {s for s in open_ if left * share[s] / weight > most[s]}
        if not over:
            for s in open_:
                give[s] = left * share[s] / weight
            break
        for s in over:
            give[s] = float(most[s])
            left -= most[s]
        open_ -= over
    return give


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 7, total: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, copies) and its report by source.

    ``targets`` is a short list of sources kept by hand; it is read to the driver.
    """
    want = targets.groupBy("source").agg(F.sum(F.greatest(F.col("target_share"), F.lit(0.0))).alias("share"), F.max(F.greatest(F.col("max_repeats"), F.lit(0))).alias("cap")).filter("source is not null").collect()
    share = {r.source: float(r.share or 0) for r in want}
    cap = {r.source: int(r.cap or 0) for r in want}
    spark = docs.sparkSession
    named = docs.select("doc_id", "source", "text").filter(F.col("source").isin(list(share)))
    sized = checkpointed(_sized(named).filter("n_tokens > 0").withColumn("h", F.xxhash64("doc_id", F.lit(seed))))
    have = {r.source: int(r.n) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # as many rows as targets
    if total == "all":
        total = float(sum(have.get(s, 0) for s in share if share[s] > 0))
    give = water_fill(share, {s: cap[s] * have.get(s, 0) for s in share}, total)
    plan = [(s, share[s], cap[s], have.get(s, 0), give[s], int(give[s] // have[s]) if have.get(s) else 0) for s in sorted(share)]
    need = {s: g - r * n for s, _, _, n, g, r in plan}
    slot = [F.pmod(F.col("h"), F.lit(SLOTS)).alias("s1"), F.pmod(F.shiftrightunsigned("h", 20), F.lit(SLOTS)).alias("s2")]
    slots = sized.select("*", *slot)
    first = _fill(slots.groupBy("source", "s1").agg(F.sum("n_tokens").alias("n")).collect(), need, lambda r: (r.source, r.s1))
    edge = {s: c for s, (c, _) in first.items()}
    fine = slots.join(_small(spark, [(s, c) for s, c in edge.items()], "source string, s1 bigint"), ["source", "s1"])
    second = _fill(fine.groupBy("source", "s2").agg(F.sum("n_tokens").alias("n")).collect(), {s: rest for s, (_, rest) in first.items()}, lambda r: (r.source, r.s2))
    rule = [(s, r, edge.get(s, -1), *second.get(s, (-1, 0.0))) for s, *_, r in plan]
    used = slots.join(_small(spark, rule, "source string, whole int, edge bigint, fine bigint, rest double"), "source")
    last = (F.col("s1") == F.col("edge")) & (F.col("s2") == F.col("fine"))
    before = (F.col("s1") < F.col("edge")) | ((F.col("s1") == F.col("edge")) & (F.col("s2") < F.col("fine")))
    out = ["doc_id", "source", "n_tokens"]
    most = used.filter(~last).select(*out, (F.col("whole") + F.when(before, 1).otherwise(0)).alias("copies"))
    upto = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    ordered = used.filter(last).withColumn("_sum", upto).select(*out, (F.col("whole") + F.when(F.col("_sum") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    mix = most.unionAll(ordered).filter("copies > 0")
    got = mix.groupBy("source").agg(F.count("*").alias("n_records"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    base = _small(spark, [(*p[:5], p[1] > 0 and p[4] >= p[2] * p[3]) for p in plan], "source string, target_share double, max_repeats int, source_tokens bigint, planned_tokens double, clamped boolean")
    every = base.join(got, "source", "left").na.fill(0)
    whole = every.agg(F.sum("tokens").alias("_all"))
    report = every.join(F.broadcast(whole)).withColumn("share", F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0)).drop("_all")
    return mix, report


def _sized(named: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens); the source rides along as part of the key."""
    key = F.struct("doc_id", "source").alias("k")
    return token_sizes(named.select(key, "text"), "k").select("k.doc_id", "k.source", "n_tokens")


def _small(spark, rows: list, schema: str) -> DataFrame:
    """A frame of as many rows as there are target sources, to be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _fill(rows: list, need: dict[str, float], key) -> dict[str, tuple[int, float]]:
    """For each source the slot in which the running token sum passes the need, and what is left to fill there.

    ``rows``: at most SLOTS a source. All slots before it are used whole.
    """
    by: dict[str, list] = {}
    for r in rows:
        s, slot = key(r)
        by.setdefault(s, []).append((slot, r.n))
    out = {}
    for s, slots in by.items():
        left = need.get(s, 0.0)
        edge = SLOTS
        for slot, n in sorted(slots):
            if n > left:
                edge = slot
                break
            left -= n
        out[s] = (edge, left)
    return out
