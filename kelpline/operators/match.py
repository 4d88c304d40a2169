"""Resolving terms through layered dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import costs, folds, weighted_similarity
from ..functions.near_any import any_near, gates, near_in_groups
from ..functions.noise import is_short_ascii
from ..functions.text import computed_once
from ..functions.tokens import SINGLES
from ..session import checkpointed, spread_by, whole_runs, written
from .hot_join import hot_join
from .pass_join import near_pairs

#: Statuses from the strictest on. A duplicate term keeps the strictest one.
STRICTNESS = ("haram", "syubhat", "unknown", "halal")
#: Least similarity of a fuzzy match; for terms up to three characters; for an unreviewed dictionary.
FUZZY, FUZZY_SHORT, FUZZY_CATALOG = 0.5, 0.85, 0.7


def strictness(status: Column, order: tuple[str, ...] = STRICTNESS) -> Column:
    """The rank of a status, strictest first; unlisted ones and null last."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), status), F.lit(0)) + F.when(status.isin(*order), 0).otherwise(len(order) + 1)


def dictionary(entries: DataFrame, key: str, term: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, ord, alias_no, key, status, ...) of all names of all entries; ``ord`` is the order of entries."""
    rows = entries.select(F.col(key).alias("ord"), "id", "status", *keep, F.posexplode("names").alias("alias_no", "alias"))
    return computed_once(rows, "term", term).filter("term <> ''")


def exact_index(terms: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per term: of its entries the strictest, then the first."""
    fields = F.struct("id", "status", "ord", "alias_no", "alias", *keep)
    best = F.min_by(fields, F.struct(strictness(F.col("status")), F.col("ord"), F.col("alias_no")))
    return terms.groupBy("term").agg(best.alias("e"), F.count("*").alias("n_aliases")).select("term", "e.*", "n_aliases")


def exact_match(tokens: DataFrame, index: DataFrame, distinct: bool = False) -> DataFrame:
    """Tokens with the entry of their term, null where there is none.

    ``distinct`` says that no term is in many rows. A one-character term counts only if it is one of the known single ones and its entry is reviewed.
    """
    e = index.select("term", F.struct("id", "status", "ord", *[c for c in ("reviewed",) if c in index.columns]).alias("entry"))
    # entries are found once a term, and the tokens of hot terms take them from a broadcast
    if distinct:
        hit = tokens.join(e, "term", "left")
    else:
        terms = tokens.filter("term is not null").groupBy("term").agg(F.count("*").alias("_tokens")).join(e, "term", "left")
        hit = hot_join(tokens, terms, "term", "_tokens", tokens.count()).drop("_tokens")
    single = F.length("term") == 1
    ok = ~single | (F.col("term").isin(*SINGLES) & (F.coalesce(F.col("entry.reviewed"), F.lit(False)) if "reviewed" in index.columns else F.lit(True)))
    return hit.withColumn("entry", F.when(ok, F.col("entry")))


def fuzzy_match(tokens: DataFrame, terms: DataFrame, least: float = FUZZY, weighted: bool = True, denied: str = STRICTNESS[0], few_terms: bool = False) -> DataFrame:
    """(term, id, status, matched_term, score) of the best near term of each distinct token.

    Excluded are tokens of one or two characters, of one to five ASCII ones, and tokens within the allowance of a ``denied``
    term, a code included (the guard runs on the same candidates, so it is never approximate); denied entries and
    additive codes can't be reached. Up to three characters the score must be high unless letters were only added or lost. The
    highest score wins, then the first entry. ``few_terms`` says that there are fewer terms than tokens.
    """
    refused = F.coalesce(F.col("status"), F.lit("")) == denied
    entry = F.struct("id", "status", "ord", "alias_no")
    free = ~refused & ~F.col("term").rlike(r"^[Ee]\d{3,4}[a-z]*\z")
    pool = terms.groupBy(F.col("term").alias("near")).agg(F.bool_or(refused).alias("refused"), F.min_by(F.when(free, entry), F.when(free, F.struct("ord", "alias_no"))).alias("e"))
    asked = tokens.select("term").distinct().filter((F.length("term") >= 3) & ~is_short_ascii(F.col("term")))
    pairs = (near_pairs(pool, asked, "near", "term") if few_terms else near_pairs(asked, pool, "term", "near")).join(pool, "near")
    # the near terms of one token are few; its refused ones shadow all others
    unshadowed = pairs.withColumn("_shadow", F.max("refused").over(Window.partitionBy("term"))).filter("not _shadow and e is not null")
    n = F.greatest(F.length("term"), F.length("near"))
    score = weighted_similarity(F.col("term"), F.col("near")) if weighted else 1 - F.col("edits") / n
    scored = unshadowed.withColumn("score", score)
    short = F.least(F.length("term"), F.length("near")) <= 3
    indel = (F.col("edits") == F.abs(F.length("term") - F.length("near"))) & (n >= 4)
    scored = scored.filter((F.col("score") >= least) & (~short | (F.col("score") >= FUZZY_SHORT) | indel))
    pick = F.min_by(F.struct("e.id", "e.status", F.col("near").alias("matched_term"), "score"), F.struct(-F.col("score"), F.col("e.ord"), F.col("e.alias_no")))
    return scored.groupBy("term").agg(pick.alias("m")).select("term", "m.*")


def first_rule(term: Column, rules: list[dict]) -> Column:
    """The first rule (id, status, patterns) one of whose patterns a term holds, as a struct; else null."""
    out = None
    for r in rules:
        hit = term.rlike("|".join(f"(?:{p})" for p in r["patterns"]))
        value = F.struct(F.concat(F.lit("rule:"), F.lit(r["id"])).alias("id"), F.lit(r["status"]).alias("status"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if out is not None else F.lit(None).cast("struct<id:string,status:string>")


def layered_match(tokens: DataFrame, curated: DataFrame, catalog: DataFrame, rules: list[dict], weighted: bool = True) -> DataFrame:
    """(term, layer, kind, id, status, matched_term, score) of each distinct term.

    In this order: exact in the curated dictionary, rule, near in the curated one, exact in the catalogue, near in
    the catalogue, nothing. Each later step sees only the terms that the earlier ones left.
    """
    asked = tokens.select("term").distinct()
    # both dictionaries are read twice; their terms are made once
    curated, catalog = written(curated), written(catalog)
    keep = tuple(c for c in ("reviewed",) if c in curated.columns)

    def exact(terms: DataFrame, index: DataFrame, layer: str) -> DataFrame:
        hit = F.struct(F.lit(layer).alias("layer"), F.lit("exact").alias("kind"), F.col("entry.id").alias("id"), F.col("entry.status").alias("status"), F.col("term").alias("matched_term"), F.lit(1.0).alias("score"))
        return exact_match(terms, index, distinct=True).withColumn("m", F.coalesce("m", F.when(F.col("entry").isNotNull(), hit))).drop("entry")

    def near(terms: DataFrame, pool: DataFrame, layer: str, least: float) -> DataFrame:
        left = terms.filter("m is null")
        found = fuzzy_match(left, pool, least, weighted, few_terms=pool.count() < left.count())
        hit = found.select("term", F.struct(F.lit(layer).alias("layer"), F.lit("fuzzy").alias("kind"), "id", "status", "matched_term", "score").alias("f"))
        return terms.join(hit, "term", "left").withColumn("m", F.coalesce("m", "f")).drop("f")

    rule = F.col("rule")
    ruled = F.when(rule.isNotNull(), F.struct(F.lit("rule").alias("layer"), F.lit("exact").alias("kind"), rule["id"].alias("id"), rule["status"].alias("status"), F.col("term").alias("matched_term"), F.lit(1.0).alias("score")))
    shape = "struct<layer:string,kind:string,id:string,status:string,matched_term:string,score:double>"
    t = exact(asked.withColumn("m", F.lit(None).cast(shape)), exact_index(curated, keep), "curated")
    t = checkpointed(t.withColumn("rule", first_rule(F.col("term"), rules)).withColumn("m", F.coalesce("m", ruled)).drop("rule"))
    t = checkpointed(exact(near(t, curated, "curated", FUZZY), exact_index(catalog), "catalog"))
    return near(t, catalog, "catalog", FUZZY_CATALOG).select("term", "m.*")


#: Labels of more findings are compared in parts, each of so many pairs, weak terms and strong ones at most; up to SPREAD parts may be a
#: twentieth of that, so that they keep all cores busy.
MANY, PART, WEAK, STRONG, SPREAD = 2000, 500_000_000, 200_000, 400_000, 24


def _is_weak(status: Column) -> Column:
    """Whether a finding gives way to a similar strong one."""
    return status.isNull() | (status == "unknown")


def collapsed(findings: DataFrame, label: str, least: float = 0.4, least_short: float = 0.5, weighted: bool = True) -> DataFrame:
    """Findings (label, ord, term, status, score) without repeats and shadows.

    Of each term the best score stays (then the first). A weak finding, one without status or of unknown
    status, goes if a strong finding of the same label is similar to it; up to three characters it must be more so. At such
    a low similarity nothing shorter than the whole term is sure to be shared, so all weak and strong terms of a label meet, exactly
    (``functions/near_any.py``): small labels many at a time, large ones in parts.
    """
    w = Window.partitionBy(label, "term").orderBy(F.col("score").desc_nulls_last(), "ord")
    first = lambda rows: rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    # terms are made once; what is kept is small, as it is compressed
    rows = written(findings)
    # at most one label for so many rows, so these are broadcast
    many = checkpointed(rows.filter(F.col(label).isNotNull()).groupBy(label).count().filter(F.col("count") > MANY).select(label))
    cost = costs() if weighted else {}
    fold = str.maketrans(folds()) if weighted else {}

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, label):
            ends = pc.run_end_encode(t[label].combine_chunks()).run_ends.to_numpy()
            weak = pc.fill_null(pc.equal(t["status"], "unknown"), True).to_numpy(zero_copy_only=False)
            terms = t["term"].to_pylist()
            there = np.array([x is not None for x in terms])
            groups = [(a + np.flatnonzero(weak[a:b] & there[a:b]), a + np.flatnonzero(~weak[a:b] & there[a:b])) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            gone = near_in_groups([x or "" for x in terms], groups, least, least_short, cost, lambda x: x.translate(fold))
            yield from t.filter(pa.array(~gone)).to_batches()

    def large(asked: pa.Table, strong: pa.Table) -> pa.Table:
        terms = asked["term"].to_pylist()
        return asked.select([label, "term"]).filter(pa.array(any_near(terms, strong["near"].to_pylist(), gates(terms, least, least_short), cost, lambda x: x.translate(fold)), pa.bool_()))

    few = spread_by(rows.join(F.broadcast(many), label, "left_anti").filter(F.col(label).isNotNull()), label)
    order = [label, "term", *[c for c in rows.columns if c not in (label, "term")]]
    out = first(few).sortWithinPartitions(label).mapInArrow(small, rows.schema).unionByName(first(rows.filter(F.col(label).isNull()))).select(order)
    if many.isEmpty():
        return out
    best = checkpointed(first(rows.join(F.broadcast(many), label)))
    terms = best.filter("term is not null").select(label, "term", _is_weak(F.col("status")).alias("_weak"))
    n, m = F.count_if("_weak"), F.count_if(~F.col("_weak"))
    sizes = terms.groupBy(label).agg(F.greatest(F.ceil(n * m / PART), F.ceil(n / WEAK), F.least(F.ceil(n * m / PART * 20), F.lit(SPREAD))).cast("int").alias("_parts"), F.ceil(m / STRONG).cast("int").alias("_pieces")).filter("_parts > 0 and _pieces > 0")
    placed = terms.join(F.broadcast(sizes), label)
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda c: F.pmod(F.xxhash64("term"), F.col(c)).cast("int")
    at = [label, "_part", "_piece"]
    asked = placed.filter("_weak").select(label, "term", one("_parts").alias("_part"), each("_pieces").alias("_piece"))
    strong = placed.filter("not _weak").select(F.col(label).alias(label), F.col("term").alias("near"), each("_parts").alias("_part"), one("_pieces").alias("_piece"))
    met = spread_by(asked, *at).groupBy(*at).cogroup(spread_by(strong, *at).groupBy(*at))
    gone = met.applyInArrow(large, terms.select(label, "term").schema).distinct()
    return out.unionByName(best.join(gone, [label, "term"], "left_anti").select(order))
