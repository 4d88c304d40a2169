"""Scoring findings against hand-made records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import alignment_score, part_of
from ..session import checkpointed, spread_small


def facts(gt: DataFrame, key: str, file: str, items: str) -> DataFrame:
    """One row for each item of each record: (key, file, gi, raw, expected, hazard)."""
    return gt.select(F.col(key).alias("gt_id"), F.col(file).alias("file_name"), F.posexplode(items).alias("gi", "_i")).select("gt_id", "file_name", "gi", "_i.raw", F.lower(F.trim("_i.expected")).alias("expected"), F.coalesce("_i.hazard", F.lit(False)).alias("hazard"))


def greedy_alignment(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs by descending score, then left, then right: what a sequential greedy pass gives.

    In each round the pairs that are the best of both their ends are taken, all at once, and blocks of ties by rank; since the
    order is total, the result is the sequential one. Rounds end when no pair is left: each takes at least the first one.
    """
    order = F.struct(-F.col(score), F.col(left), F.col(right))
    open_ = checkpointed(pairs.select(left, right, score).withColumn("_o", order))
    taken, rounds = None, 0
    while not open_.isEmpty():
        a = open_.groupBy(left).agg(F.min("_o").alias("_l"))
        b = open_.groupBy(right).agg(F.min("_o").alias("_r"))
        first = open_.join(a, left).join(b, right).filter("_o = _l and _o = _r").select(left, right, score)
        best = checkpointed(first.unionByName(_tied(open_, left, right, score)).distinct())
        taken, rounds = best if taken is None else taken.unionByName(best), rounds + 1
        if rounds % 16 == 0:  # keeps the plan short
            taken = checkpointed(taken)
        open_ = checkpointed(open_.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti"))
    return taken if taken is not None else pairs.select(left, right, score).limit(0)


def _tied(open_: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs by rank of blocks of ties: lefts and rights all of which have each other, and no one else, as their best.

    The sequential pass gives the k-th left of a block its k-th right. Lefts are grouped by a hash of their best rights; counts
    then tell exactly whether a group is a block.
    """
    top_l, top_r = (open_.groupBy(c).agg(F.max(score).alias(n)) for c, n in ((left, "_sl"), (right, "_sr")))
    top = open_.join(top_l, left).join(top_r, right).select(left, right, score, "_sl", "_sr")
    of_l = top.filter(F.col(score) == F.col("_sl")).groupBy(left).agg(F.count("*").alias("_nr"), F.bit_xor(F.xxhash64(right)).alias("_b"), F.bool_and(F.col(score) == F.col("_sr")).alias("_ok"))
    of_r = top.filter(F.col(score) == F.col("_sr")).groupBy(right).agg(F.count("*").alias("_nl"))
    key = ["_b", "_nr", score]
    both = top.filter((F.col(score) == F.col("_sl")) & (F.col(score) == F.col("_sr"))).join(of_l, left).join(of_r, right)
    sums = both.groupBy(*key).agg(F.countDistinct(left).alias("_a"), F.countDistinct(right).alias("_c"), F.bool_and("_ok").alias("_all"), F.min("_nl").alias("_lo"), F.max("_nl").alias("_hi"))
    block = both.join(sums.filter("_all and _c = _nr and _lo = _a and _hi = _a").select(*key), key)
    ranked = [block.select(*key, c).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(c))) for c in (left, right)]
    return ranked[0].join(ranked[1], [*key, "_k"]).select(left, right, score)


def aligned(items: DataFrame, findings: DataFrame, least: float = 0.6) -> DataFrame:
    """(file_name, gt_no, finding_no, score) of items and findings of one image, one to one.

    All pairs of an image are scored; ``items`` has (file_name, gt_no, term), ``findings`` (file_name, finding_no, term) and may have
    matched_term, both numbers unique. Terms are texts as read, whose brackets count.
    """
    full = _scored(items.select("file_name", "gt_no", "term"), findings.drop("status"), least)
    got = greedy_alignment(full.select("gt_no", "finding_no", "score"), "gt_no", "finding_no", "score")
    return got.join(items.select("gt_no", "file_name"), "gt_no").select("file_name", "gt_no", "finding_no", "score")


def _scored(items: DataFrame, findings: DataFrame, least: float) -> DataFrame:
    """All pairs of items and findings of one image that score ``least``; an image's items are few."""
    found = findings.withColumnRenamed("term", "_near")
    texts = [F.col(c) for c in ("_near", "matched_term") if c in found.columns]
    return spread_small(items.join(found, "file_name")).withColumn("score", alignment_score(F.col("term"), *texts)).filter(F.col("score") >= least).drop(*[c for c in ("_near", "matched_term") if c in found.columns])


def scored_pairs(items: DataFrame, findings: DataFrame, least: float = 0.6) -> DataFrame:
    """(file_name, gt_no, finding_no, expected, status, score) of near items and findings of one image.

    ``items`` has (file_name, gt_no, term, expected), ``findings`` (file_name, finding_no, term, status) and may have matched_term; of the
    repeats of a term in an image the first finding stands for each status, so no list of repeats is multiplied out.
    """
    by = [c for c in ("file_name", "term", "matched_term", "status") if c in findings.columns]
    first = findings.groupBy(*by).agg(F.min("finding_no").alias("finding_no"))
    return _scored(items, first, least).select("file_name", "gt_no", "finding_no", "expected", "status", "score")


def preferred(items: DataFrame, findings: DataFrame, alignment: DataFrame, least: float = 0.6, risky: tuple[str, ...] = ("syubhat", "haram")) -> DataFrame:
    """The alignment after the repair pass: a risky item whose finding has another status than expected, or that has none, takes the
    best finding of the expected status that is a part of the item's text; several items may share it.
    """
    status = findings.select("finding_no", "status")
    now = items.join(alignment.select("gt_no", "finding_no", "score"), "gt_no", "left").join(status, "finding_no", "left")
    open_ = now.filter(F.col("expected").isin(*risky) & ~F.coalesce(F.col("status") == F.col("expected"), F.lit(False))).select("file_name", "gt_no", "term", "expected")
    texts = [c for c in ("term", "matched_term") if c in findings.columns]
    found = findings.groupBy("file_name", *texts, "status").agg(F.min("finding_no").alias("finding_no")).filter(F.col("status").isin(*risky)).withColumnRenamed("term", "_near")
    near = [F.col("_near" if c == "term" else c) for c in texts]
    pairs = spread_small(open_.join(found, (open_["file_name"] == found["file_name"]) & (open_["expected"] == found["status"])).drop(found["file_name"], found["status"]))
    fits = pairs.filter(part_of(F.col("term"), *near)).withColumn("score", alignment_score(F.col("term"), *near))
    best = fits.groupBy("gt_no").agg(F.min_by(F.struct("finding_no", "score"), F.struct(-F.col("score"), F.col("finding_no"))).alias("b"))
    j = now.join(best, "gt_no", "left")
    swap = F.col("b").isNotNull()
    out = j.select("file_name", "gt_no", F.when(swap, F.col("b.finding_no")).otherwise(F.col("finding_no")).alias("finding_no"), F.when(swap, F.col("b.score")).otherwise(F.col("score")).alias("score"), swap.alias("repaired"))
    return out.filter("finding_no is not null")


def with_overrides(alignment: DataFrame, overrides: DataFrame) -> DataFrame:
    """Hand-made (gt_no, finding_no) pairs first, many to one if they say so; of the alignment what doesn't touch them."""
    rest = alignment.join(overrides.select("gt_no"), "gt_no", "left_anti").join(overrides.select("finding_no"), "finding_no", "left_anti")
    return overrides.select("gt_no", "finding_no", F.lit(1.0).alias("score")).unionByName(rest.select("gt_no", "finding_no", "score"))


def zipped(a: DataFrame, b: DataFrame, by: str, left: str, right: str, order_left: str, order_right: str) -> DataFrame:
    """(by, left, right): rows of two tables paired by position where a group has equally many in both."""

    def placed(t: DataFrame, no: str, order: str) -> DataFrame:
        w = Window.partitionBy(by)
        return t.select(by, no, F.row_number().over(w.orderBy(order, no)).alias("_k"), F.count("*").over(w).alias("_n"))

    return placed(a, left, order_left).join(placed(b, right, order_right), [by, "_k", "_n"]).select(by, left, right)


def correlated(a: DataFrame, b: DataFrame, by: str, left: str, right: str, order_left: str, order_right: str, score: Column, least: float = 0.25) -> DataFrame:
    """(left, right, score): rows of two tables of one ``by``, by position where there are equally many, else greedily by ``score``."""
    even = zipped(a, b, by, left, right, order_left, order_right)
    odd = [t.join(even.select(by).distinct(), by, "left_anti") for t in (a, b)]
    pairs = odd[0].join(odd[1], by).withColumn("_s", score).filter(F.col("_s") >= least).select(left, right, "_s")
    return even.select(left, right, F.lit(None).cast("double").alias("score")).unionByName(greedy_alignment(pairs, left, right, "_s").withColumnRenamed("_s", "score"))


def effective_status(status: Column, reviewed: Column, allowed: str = "halal", unknown: str = "unknown") -> Column:
    """What may be shown: an unreviewed entry never counts as allowed."""
    return F.when((status == allowed) & (reviewed == F.lit(False)), unknown).otherwise(status)


def image_rollup(rows: DataFrame) -> DataFrame:
    """(file_name, n, judged, unknown, unmatched, correct) of the items of each image."""
    counts = {"judged": F.col("outcome").isin("correct", "wrong"), **{k: F.col("outcome") == k for k in ("unknown", "unmatched", "correct")}}
    return rows.groupBy("file_name").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])


def outcome(expected: Column, status: Column, matched: Column) -> Column:
    """What became of an item: correct, wrong, unknown, unmatched, unexpected or unjudged."""
    return (
        F.when(~matched, "unmatched").when(expected.isNull(), "unjudged").when(status.isNull(), "unexpected")
        .when(expected == status, "correct").when(status == "unknown", "unknown").otherwise("wrong")
    )


def metrics(rows: DataFrame, by: tuple[str, ...] = (), denied: str = "haram", allowed: str = "halal") -> DataFrame:
    """The metric suite over rows of (expected, hazard, status, outcome, file_name), divisions guarded.

    Shares are rounded to six decimals; with no hazard the hazard recall is 1, with nothing judged accuracy is 0.
    """

    def share(a: Column, b: Column, none: float) -> Column:
        return F.when(b == 0, none).otherwise(F.round(a / b, 6))

    judged = F.count_if(F.col("outcome").isin("correct", "wrong"))
    n = F.count("*")
    g = rows.groupBy(*by) if by else rows.groupBy()
    return g.agg(
        n.alias("items"), F.countDistinct("file_name").alias("images"), judged.alias("judged"), F.count_if(F.col("outcome") == "correct").alias("correct"),
        share(judged, n, 0.0).alias("classification_recall"), share(F.count_if(F.col("hazard") & (F.col("outcome") != "unmatched")), F.count_if("hazard"), 1.0).alias("hazard_recall"),
        share(F.count_if(F.col("outcome") == "unknown"), n, 0.0).alias("unknown_rate"), share(F.count_if(F.col("outcome") == "unmatched"), n, 0.0).alias("unmatched_rate"),
        share(F.count_if(F.col("outcome") == "correct"), judged, 0.0).alias("accuracy"), share(F.count_if(F.col("outcome") == "correct"), n, 0.0).alias("end_to_end"),
        F.count_if((F.col("status") == allowed) & (F.col("expected") == denied)).alias("false_allowed"), F.count_if((F.col("status") == denied) & (F.col("expected") == allowed)).alias("false_denied"),
    )


def thresholds(row: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value, limit, passed, all_passed) of a one-row table of metrics."""
    parts = [row.select(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(v).alias("limit_value"), (F.col(m) >= v if op == ">=" else F.col(m) <= v).alias("passed")) for m, (op, v) in limits.items()]
    t = reduce(DataFrame.unionAll, parts)
    return t.join(F.broadcast(t.agg(F.bool_and("passed").alias("all_passed"))))  # one row


def run_summary(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(count, mean, median, least, most) with the exact median, for each group."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def record_quality(gt: DataFrame, key: str, file: str, items: str, allowed: tuple[str, ...]) -> DataFrame:
    """(problem, n): repeated files, missing names, records without items, items without text or said before in their record, values out of the list."""
    one = gt.select(F.col(key).alias("k"), F.col(file).alias("f"), F.col(items).alias("i"))
    expected = F.transform("i", lambda x: F.lower(F.trim(x["expected"])))
    said = F.filter(F.coalesce(F.transform("i", lambda x: F.trim(x["raw"])), F.array().cast("array<string>")), lambda x: x != "")
    rows = one.agg(
        F.count_if(F.expr("f is null or f = ''")).alias("missing_file"), F.count_if(F.expr("i is null or size(i) = 0")).alias("no_items"),
        F.coalesce(F.sum(F.size(F.filter("i", lambda x: F.coalesce(x["raw"], F.lit("")) == ""))), F.lit(0)).alias("empty_item"),
        F.coalesce(F.sum(F.size(said) - F.size(F.array_distinct(said))), F.lit(0)).alias("repeated_item"),
        F.coalesce(F.sum(F.size(F.filter(expected, lambda x: ~F.coalesce(x, F.lit("")).isin(*allowed)))), F.lit(0)).alias("invalid_expected"),
    )
    named = rows.selectExpr("stack(5, 'missing_file', missing_file, 'no_items', no_items, 'empty_item', empty_item, 'repeated_item', repeated_item, 'invalid_expected', invalid_expected) as (problem, n)")
    twice = one.filter("f is not null").groupBy("f").count().filter("count > 1").agg(F.count("*").alias("n"))
    return named.unionByName(twice.select(F.lit("repeated_file").alias("problem"), "n"))


def overlap(a: DataFrame, b: DataFrame, path: str) -> DataFrame:
    """Paths of ``a`` that ``b`` has as well, in full or by their last part."""
    from ..functions.text import basename, norm_path

    left = a.select(F.col(path).alias("path")).filter("path is not null").distinct()
    full = left.join(b.select(norm_path(F.col(path)).alias("_k")).distinct(), norm_path(F.col("path")) == F.col("_k"), "left_semi")
    part = left.join(b.select(basename(F.col(path)).alias("_k")).distinct(), basename(F.col("path")) == F.col("_k"), "left_semi")
    return full.union(part).distinct()


def duplicate_terms(terms: DataFrame) -> DataFrame:
    """(term, statuses, n): terms that entries of different status share."""
    return terms.groupBy("term").agg(F.array_sort(F.collect_set("status")).alias("_s"), F.count("*").alias("n")).filter("size(_s) > 1").select("term", F.array_join("_s", ",").alias("statuses"), "n")


def histogram(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each value, most frequent first within ``by``, ties by value in binary order."""
    return rows.groupBy(*by, value).agg(F.count("*").alias("n"))
