"""Frequency of every distinct term over a whole collection.

Every block of records is counted once where it is read: its terms are dictionary-encoded, their
occurrences and the records that hold them are accumulated in count arrays, and one row per identifier
range carries these arrays on. The reducer of a range builds its part of the global integer dictionary
(identifier = range number * 2^40 + index of the term in the sorted range), encodes the blocks' terms by
it, and sums the arrays. So a term, however common, reaches its reducer once per block.

Defined results: null terms don't count, the empty string is a term like any other; a term that occurs
several times in one record counts that often, but the record once; null and empty arrays give nothing;
weights may be null (taken as 0). No term is trimmed or folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = "range int, terms array<string>, occurrences array<bigint>, records array<bigint>"
_COUNTS = "term_no bigint, term string, n_occurrences bigint, n_records bigint"


def term_counts(df: DataFrame, terms: str, weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """(term_no, term, n_occurrences, n_records) of ``terms``, a string or array<string> column.

    ``weight``: a bigint column to sum as occurrences instead of counting rows. ``ranges``: the number of
    identifier ranges; by default four a partition of the input, 64 at least, so that what one reducer
    holds doesn't grow with the input.
    """
    whole = F.col(terms) if dict(df.dtypes)[terms].startswith("array") else F.array(terms)
    amount = F.coalesce(F.col(weight).cast("bigint"), F.lit(0)) if weight else F.lit(1).cast("bigint")
    src = df.select(whole.alias("terms"), amount.alias("weight")).filter("terms is not null and size(terms) > 0")
    parts = ranges or max(64, 4 * src.rdd.getNumPartitions())

    def count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        occ, rec = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

        def emit() -> Iterator[pa.RecordBatch]:
            if not names:
                return
            term = pa.array(list(names), pa.string())
            n = len(names)
            part = _ranges(term, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            used = np.flatnonzero(np.diff(cuts))
            offs = pa.array(np.append(cuts[used], cuts[-1]).astype(np.int32))
            o = pa.array(order)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(offs, term.take(o)), pa.ListArray.from_arrays(offs, pa.array(occ[:n][order])), pa.ListArray.from_arrays(offs, pa.array(rec[:n][order]))],
                names=["range", "terms", "occurrences", "records"],
            )

        for batch in batches:
            lists = batch.column(0)
            flat, parent = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
            there = np.asarray(flat.is_valid())
            if not there.any():
                continue
            enc = flat.filter(pa.array(there)).dictionary_encode()
            parent, code = parent[there], np.asarray(enc.indices).astype(np.int64)
            local = np.array([names.setdefault(t, len(names)) for t in enc.dictionary.to_pylist()], np.int64)
            if len(names) > len(occ):
                occ = np.concatenate([occ, np.zeros(max(len(occ), len(names)), np.int64)])
                rec = np.concatenate([rec, np.zeros(len(occ) - len(rec), np.int64)])
            w = np.asarray(batch.column(1))[parent]
            total = np.zeros(len(local), np.int64)
            np.add.at(total, code, w)
            occ[local] += total
            once = np.unique(parent.astype(np.int64) * len(local) + code) % len(local)
            rec[local] += np.bincount(once, minlength=len(local))
            if len(names) >= 500_000:  # a block ends: memory stays bounded, sums don't change
                yield from emit()
                names = {}
                occ[:], rec[:] = 0, 0
        yield from emit()

    def sum_range(key: tuple, table: pa.Table) -> pa.Table:
        flat = table.column("terms").combine_chunks()
        flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
        enc = flat.flatten().dictionary_encode()
        rank = pc.sort_indices(enc.dictionary)
        code = np.asarray(enc.indices)
        sums = []
        for c in ("occurrences", "records"):
            v = np.asarray(table.column(c).combine_chunks().flatten())
            s = np.zeros(len(enc.dictionary), np.int64)
            np.add.at(s, code, v)
            sums.append(pa.array(s).take(rank))
        number = (int(key[0].as_py()) << 40) + np.arange(len(rank), dtype=np.int64)
        return pa.table({"term_no": number, "term": enc.dictionary.take(rank), "n_occurrences": sums[0], "n_records": sums[1]})

    return src.mapInArrow(count_blocks, _BLOCK).groupBy("range").applyInArrow(sum_range, _COUNTS)


def _ranges(term: pa.Array, parts: int) -> np.ndarray:
    """The identifier range of each term: a polynomial hash of its bytes, in vector form."""
    term = term.cast(pa.large_string())
    offs = np.frombuffer(term.buffers()[1], np.int64, len(term) + 1)
    raw = np.frombuffer(term.buffers()[2] or b"", np.uint8)[: offs[-1]].astype(np.uint64)
    at = np.arange(len(raw), dtype=np.uint64) - np.repeat(offs[:-1].astype(np.uint64), np.diff(offs))
    mixed = (raw + np.uint64(1)) * (at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9))
    mixed ^= mixed >> np.uint64(29)
    upto = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(mixed, out=upto[1:])
    h = upto[offs[1:]] - upto[offs[:-1]]
    h ^= h >> np.uint64(31)
    return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(33)).astype(np.int64) % parts


def marked(counts: DataFrame, measure: str, total: DataFrame, rare: int, common: float) -> DataFrame:
    """``counts`` with ``mark``: rare up to ``rare``, common above the share ``common`` of ``total.n``."""
    t = total.select(F.col("n").alias("_total"))
    mark = F.when(F.col(measure) <= rare, "rare").when(F.col(measure) > common * F.col("_total"), "common")
    return counts.join(F.broadcast(t)).withColumn("mark", mark).drop("_total")  # one row


def scan_and_corpus_terms(scans: DataFrame, corpus: DataFrame) -> DataFrame:
    """Counts and marks of scan_log.miss and corpus_tokens.raw."""
    miss = marked(term_counts(scans, "miss"), "n_records", scans.agg(F.count("*").alias("n")), 2, 0.10)
    rows = corpus.filter("bucket is not null")
    raw = marked(term_counts(rows, "raw", "n"), "n_occurrences", rows.agg(F.sum("n").alias("n")), 2, 0.02)
    cols = ["field", "term", "n_occurrences", "n_records", "mark"]
    return miss.withColumn("field", F.lit("scan_log.miss")).select(cols).unionAll(raw.withColumn("field", F.lit("corpus_tokens.raw")).select(cols))
