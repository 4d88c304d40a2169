"""Building dictionaries from several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_defaults(parts: list[DataFrame], defaults: dict[str, object]) -> DataFrame:
    """Entry tables under each other, missing columns null, nulls replaced by defaults."""
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for c, v in defaults.items():
        all_ = all_.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in all_.columns else F.lit(v))
    return all_


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) with the value of each key's last row that has one."""
    return rows.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def arbitrated(official: DataFrame, community: DataFrame, taxonomy: DataFrame, code: str, status: str, denied: str = "haram", allowed: str = "halal", doubt: str = "syubhat") -> DataFrame:
    """(code, status, basis, n_sources) of every code of three sources with one status a code.

    The decision table, first case that holds: official and another source agree; official alone; official
    against another (the stricter stands, basis conflict); community and taxonomy agree; they disagree
    (doubt); one of them alone (its status, single-source); none.
    """
    o, c, t = (s.select(code, F.col(status).alias(n)) for s, n in ((official, "_o"), (community, "_c"), (taxonomy, "_t")))
    j = o.join(c, code, "full").join(t, code, "full")
    O, C, T = F.col("_o"), F.col("_c"), F.col("_t")  # noqa: E741
    other = F.coalesce(C, T)
    agrees = (O == C) | (O == T)
    strict = F.when((O == denied) | (C == denied) | (T == denied), denied).when((O == doubt) | (C == doubt) | (T == doubt), doubt).otherwise(F.coalesce(O, other, F.lit("unknown")))
    verdict = (
        F.when(O.isNotNull() & agrees, F.struct(O.alias("s"), F.lit("cross-source").alias("b")))
        .when(O.isNotNull() & other.isNull(), F.struct(O.alias("s"), F.lit("official").alias("b")))
        .when(O.isNotNull(), F.struct(strict.alias("s"), F.lit("conflict").alias("b")))
        .when(C == T, F.struct(C.alias("s"), F.lit("cross-source").alias("b")))
        .when(C.isNotNull() & T.isNotNull(), F.struct(F.lit(doubt).alias("s"), F.lit("conflict").alias("b")))
        .when(other.isNotNull(), F.struct(other.alias("s"), F.lit("single-source").alias("b")))
        .otherwise(F.struct(F.lit("unknown").alias("s"), F.lit("none").alias("b")))
    )
    n = sum((x.isNotNull().cast("int") for x in (O, C, T)), F.lit(0))
    return j.select(code, verdict["s"].alias(status), verdict["b"].alias("basis"), n.alias("n_sources"))


def preferred_names(codes: DataFrame, named: list[DataFrame], code: str, name: str) -> DataFrame:
    """Each code with the name of the first source that has one, else the code itself."""
    out = codes.select(code).distinct()
    for i, s in enumerate(named):
        out = out.join(s.groupBy(code).agg(F.min(name).alias(f"_n{i}")), code, "left")
    return out.select(code, F.coalesce(*[F.col(f"_n{i}") for i in range(len(named))], F.col(code)).alias(name))


def owned_names(names: DataFrame, owner: str, name: str, canonical: DataFrame | None = None) -> DataFrame:
    """(owner, name) after resolving names that several owners claim.

    Such a name stays with its canonical owners if it has any, else with the owner it spells, else with
    none. A name that is an owner's own code is never taken from it.
    """
    rows = names.select(owner, name).distinct()
    claims = rows.groupBy(name).agg(F.count("*").alias("_n"))
    spell = F.lower(F.regexp_replace(F.col(name), r"[^0-9A-Za-z]", "")) == F.lower(F.regexp_replace(F.col(owner), r"[^0-9A-Za-z]", ""))
    j = rows.join(claims, name).withColumn("_own", spell)
    if canonical is not None:
        j = j.join(canonical.select(owner, name, F.lit(True).alias("_canon")).distinct(), [owner, name], "left")
        has = canonical.select(name).distinct().withColumn("_decided", F.lit(True))
        j = j.join(has, name, "left")
    else:
        j = j.withColumn("_canon", F.lit(None).cast("boolean")).withColumn("_decided", F.lit(None).cast("boolean"))
    no = F.lit(False)
    keep = (F.col("_n") == 1) | F.col("_own") | F.coalesce(F.col("_canon"), no)
    return j.filter(keep & ((F.col("_n") == 1) | F.coalesce(F.col("_canon"), no) | F.col("_own"))).select(owner, name)


def new_tokens(tokens: DataFrame, known: DataFrame, term: str, order: str, prefix: str = "jp-") -> DataFrame:
    """(id, term, raw) of tokens whose term isn't known, first seen first, with running ids.

    Numbering is global, by a per-partition count and offsets (``row_number`` over range partitions), not in one task.
    """
    fresh = tokens.join(known.select(term).distinct(), term, "left_anti")
    first = fresh.groupBy(term).agg(F.min_by("raw", order).alias("raw"), F.min(order).alias("_first"))
    return numbered(first, "_first").select(F.concat(F.lit(prefix), F.col("_no").cast("string")).alias("id"), term, "raw")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``_no`` from 0 in the order of a unique column, ranking range partitions in parallel."""
    n = df.sparkSession.sparkContext.defaultParallelism
    parts = df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id())
    counts = parts.groupBy("_part").agg(F.count("*").alias("_c"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    w = Window.partitionBy("_part").orderBy(order)
    return parts.withColumn("_r", F.row_number().over(w)).join(F.broadcast(base.select("_part", "_base")), "_part").withColumn("_no", F.col("_r") - 1 + F.col("_base")).drop("_part", "_r", "_base")


def citations(names: DataFrame, cited: DataFrame, key: str, term: str, org: str) -> DataFrame:
    """(key, orgs): the organisations that cite any name of a key, each once, in the order of its names and then their own."""
    rows = names.join(cited, term)
    first = rows.groupBy(key, org).agg(F.min(F.struct("ord", "org_no")).alias("_at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", org))), lambda x: x[org]).alias("orgs"))


def content_version(df: DataFrame, size: int = 12) -> DataFrame:
    """(version) of a table's content whatever the order of its rows: a hash of summed row hashes."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    h = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(h.alias("h")).agg(F.substring(F.sha2(F.concat_ws(":", F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).cast("string"), F.count("*").cast("string")), 256), 1, size).alias("version"))


def upsert(current: DataFrame, proposed: DataFrame, key: str, union: tuple[str, ...], replace: tuple[str, ...]) -> DataFrame:
    """A new snapshot: array columns in ``union`` are merged, ``replace`` columns refreshed, other rows kept or added.

    Applying the same proposal twice changes nothing more.
    """
    cur, new = current.alias("c"), proposed.alias("p")
    j = cur.join(new, F.col(f"c.{key}") == F.col(f"p.{key}"), "full")
    out = []
    for c in current.columns:
        a, b = F.col(f"c.{c}"), F.col(f"p.{c}") if c in proposed.columns else F.lit(None)
        if c == key or c in replace:
            v = F.coalesce(b, a) if c in replace else F.coalesce(a, b)
        elif c in union:
            v = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_union(a, b))
        else:
            v = F.coalesce(a, b)
        out.append(v.alias(c))
    return j.select(*out)


def proposals(items: DataFrame, skips: dict[str, Column], key: str) -> DataFrame:
    """``items`` with ``skip``, the first reason that holds, or that the key came before; null means accepted."""
    out = None
    for name, cond in skips.items():
        out = F.when(cond, name) if out is None else out.when(cond, name)
    marked = items.withColumn("skip", out)
    w = Window.partitionBy(key, F.col("skip").isNull()).orderBy("ord")
    return marked.withColumn("_n", F.row_number().over(w)).withColumn("skip", F.when(F.col("skip").isNull() & (F.col("_n") > 1), "duplicate-id").otherwise(F.col("skip"))).drop("_n")


def flips(before: DataFrame, after: DataFrame, term: str, status: str) -> DataFrame:
    """(before, after, n) of terms whose status changed between two resolutions."""
    j = before.select(term, F.col(status).alias("before")).join(after.select(term, F.col(status).alias("after")), term)
    return j.filter(~F.col("before").eqNullSafe(F.col("after"))).groupBy("before", "after").agg(F.count("*").alias("n"))


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): how many rows, repeats counted, each of two tables has that the other lacks."""
    left = a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit("left").alias("side"), "n")
    return left.unionAll(b.exceptAll(a).agg(F.count("*").alias("n")).select(F.lit("right").alias("side"), "n"))


def status_conflicts(a: DataFrame, b: DataFrame, code: str, status: str) -> DataFrame:
    """(code, left_status, right_status) of codes two tables judge differently."""
    left = a.select(code, F.col(status).alias("left_status")).distinct()
    right = b.select(code, F.col(status).alias("right_status")).distinct()
    return left.join(right, code).filter("left_status <> right_status")
