"""Duplicates hidden by formatting: records equal apart from white space, case, punctuation and order.

1. Every record gets a canonical string (computed in the JVM) and a 64-bit hash of it.
2. Each partition sets the bits of its hashes in a once-seen and a seen-again Bloom filter; what
   is shipped are the sorted bit positions, by segment. Segments are merged with (once, again) x (once',
   again') = (once | once', again | again' | once & once'), which leaves the possible repeats.
3. Only rows whose bits are all in the seen-again filter are shuffled for exact grouping by the canonical
   string's SHA-256; all others are singletons and never leave their partition.

A filter has ``max_bits`` (32 MB) at most, enough for 16 bits a row of 16 million rows. A larger table is written once in
slices of the hash range, without a shuffle, and its slices are filtered one after the other, each with its own filter: at any
size rows are shuffled only if they may repeat, and what is broadcast doesn't grow. Groups are aggregated before
they are shuffled. Copies learn their representative through a join in which the few groups with more
than a thousandth of all rows (so fewer than a thousand of them) are broadcast: no hot group is in one task.

Defined results: null equals only null, not the empty string, array or value; empty elements of ``names``
and ``sources`` count as elements; repeated names in one record count each. All columns but the key and
those in ``skip`` are compared, whatever they are called; an empty table has no copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..operators.hot_join import hot_join
from ..session import checkpointed, written

SEGMENT = 1 << 16
_JUNK = r"[\s\p{Z}\p{P}\x00-\x1f]+"


def plain(c: Column) -> Column:
    """A string without white space, punctuation and letter case."""
    return F.lower(F.regexp_replace(c, _JUNK, ""))


def canonical(df: DataFrame, skip: tuple[str, ...]) -> Column:
    """One string for all columns but ``skip``; arrays of strings are compared as multisets."""
    parts = []
    for name, kind in sorted(df.dtypes):
        if name in skip:
            continue
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            v = F.to_json(F.array_sort(F.transform(c, lambda x: F.coalesce(F.concat(F.lit("="), plain(x)), F.lit("null")))))
        elif kind == "string":
            v = F.to_json(F.array(plain(c)))
        else:
            v = c.cast("string")
        parts.append(F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), v)))
    return F.concat_ws("\u0001", *parts)


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions for each hash."""
    u = h.astype(np.uint64)
    a = (u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    b = (u * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    return np.stack([a % np.uint64(bits), b % np.uint64(bits)]).astype(np.int64)


def repeat_filter(hashes: DataFrame, bits: int) -> bytes:
    """The seen-again Bloom filter of the column ``h``: ``bits`` / 8 bytes, bounded by the caller."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = [np.concatenate(_bits(np.asarray(b.column(0)), bits)) for b in batches]
        if not pos or not sum(map(len, pos)):
            return
        at, n = np.unique(np.concatenate(pos), return_counts=True)
        seg = at // SEGMENT
        cuts = np.flatnonzero(np.diff(seg, prepend=-1))
        segs, offs = seg[cuts], np.append(cuts, len(at))
        again = n > 1
        upto = np.concatenate([[0], np.cumsum(again)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(segs), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array((at % SEGMENT).astype(np.int32))), pa.ListArray.from_arrays(pa.array(upto[offs].astype(np.int32)), pa.array((at[again] % SEGMENT).astype(np.int32)))],
            names=["segment", "once", "again"],
        )

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        once = np.asarray(t.column("once").combine_chunks().flatten())
        again = np.asarray(t.column("again").combine_chunks().flatten())
        seen = np.bincount(once, minlength=SEGMENT) > 1
        seen[again] = True
        if not seen.any():
            return pa.table({"segment": pa.array([], pa.int64()), "filter": pa.array([], pa.binary())})
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())})

    merged = hashes.select("h").mapInArrow(local, "segment bigint, once array<int>, again array<int>").groupBy("segment").applyInArrow(merge, "segment bigint, filter binary")
    out = bytearray(bits // 8)
    for r in merged.toLocalIterator():  # bits / 8 bytes in all
        out[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = r.filter
    return bytes(out)


def copies(df: DataFrame, key: str, skip: tuple[str, ...] = ("id",), max_bits: int = 1 << 28) -> DataFrame:
    """(keep_no, copy_no, copies) of every row: the smallest key of its copies, its own, their number."""
    rows = df.select(F.col(key).cast("bigint").alias("copy_no"), canonical(df, (key, *skip)).alias("form"))
    rows = rows.withColumn("h", F.xxhash64("form"))
    total = df.count()
    slices = -(-16 * total // max_bits)
    if slices <= 1:
        flagged = _flagged(rows.select("copy_no", "h", F.unhex(F.sha2("form", 256)).alias("form")), rows, total)
    else:
        part = F.pmod(F.shiftright("h", 40), F.lit(slices)).cast("int")
        table = written(rows.select("copy_no", "h", F.unhex(F.sha2("form", 256)).alias("form"), part.alias("slice")), "slice")
        parts = [table.filter(F.col("slice") == k).drop("slice") for k in range(slices)]
        # each slice is flagged and written before the next one is filtered
        flagged = reduce(DataFrame.unionAll, [written(_flagged(p, p, -(-2 * total // slices)), "maybe") for p in parts]).select("copy_no", "h", "form", "maybe")
    alone = flagged.filter("not maybe").select(F.col("copy_no").alias("keep_no"), "copy_no", F.lit(1).cast("bigint").alias("copies"))
    # keys and digests of the possible repeats are written once, as three branches read them
    some = checkpointed(flagged.filter("maybe").select("copy_no", "form"))
    groups = some.groupBy("form").agg(F.min("copy_no").alias("keep_no"), F.count("*").alias("copies"))
    cols = ["keep_no", "copy_no", "copies"]
    return alone.unionAll(hot_join(some, groups, "form", "copies", total).select(cols))


def _flagged(rows: DataFrame, hashes: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``maybe``: whether the filter of all ``hashes`` (of about ``total`` rows) has them more than once."""
    bits = SEGMENT
    while bits < 16 * total:
        bits *= 2
    shared = rows.sparkSession.sparkContext.broadcast(repeat_filter(hashes, bits))

    @F.pandas_udf(BooleanType())
    def maybe(h: pd.Series) -> pd.Series:
        f = np.frombuffer(shared.value, np.uint8)
        p = _bits(h.to_numpy(), bits)
        return pd.Series(np.all((f[p >> 3] >> (p & 7)) & 1, axis=0).astype(bool))

    return rows.withColumn("maybe", maybe("h"))


def collapsed(df: DataFrame, key: str, skip: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per record, the one with the smallest key, with the number of its copies."""
    kept = copies(df, key, skip).filter("keep_no = copy_no").select(F.col("keep_no").alias(key), F.col("copies").alias("n_copies"))
    return df.drop("n_copies").join(kept, key)
