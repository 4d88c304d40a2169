"""Several values packed in one field: one row per value, with its position.

The strings of an Arrow batch are scanned as one flat code-point array. Quote parity and bracket
depth are cumulative sums that restart per row, delimiters are a mask over the array, and the spans
between delimiters become the child offsets of a list array that is flattened with the ordinal of its
parent. No string is looked at on its own.

Defined results
* null, empty and all-delimiter strings give no value (``min_values`` decides about single values);
* values are trimmed; empty values are dropped and do not count; ``pos`` counts from 1;
* an enclosing pair of quotes is removed, a doubled ``""`` inside it becomes one; a row whose quote
  marks or brackets don't pair is read as if those marks were ordinary characters;
* what stands in quotes or brackets or between two digits is never split;
* ``1.``, ``1)`` numbering (only where the string starts with number 1 and counts up) and circled numbers separate; the
  bracket of such a number is none;
* one closing full stop of the whole string belongs to no value;
* repeated strings each give their own rows; other columns of the input are dropped, so that names
  that clash with the result's can't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codepoints import to_block, to_strings

#: Characters that separate values. Line ends separate as well.
DELIMITERS = "、,，､;；|｜/／・･+＋\t\n\r"
#: Brackets and one-way quotes: what stands between them stays whole.
OPEN, CLOSE = "(（[［{｛【〔「『“", ")）]］}｝】〕」』”"
QUOTES_OPEN, QUOTES_CLOSE = "「『“", "」』”"
STOPS = "。．."
#: White space beyond ASCII.
SPACES = " \t\n\r\x0b\x0c                 　﻿"

SCHEMA = "field string, row_id bigint, elem int, pos int, val string"


def _among(cp: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(cp, np.array([ord(c) for c in chars], np.uint32))


def _running(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Cumulative sum of x that restarts at every row; inclusive."""
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=total[1:])
    return total[1:] - np.repeat(total[start[:-1]], np.diff(start))


def split_block(col: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Parent ordinals, positions from 1, and values of every value in a string column."""
    b = to_block(col)
    cp, start = b.cp, b.start
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.string())
    rows, nrow = b.rows, len(start) - 1
    space = _among(cp, SPACES)
    digit = (cp >= 48) & (cp <= 57)

    quote = cp == 34
    parity = _running(quote, start)
    odd = np.zeros(nrow, bool)
    ends = start[1:] > start[:-1]
    odd[ends] = parity[start[1:][ends] - 1] % 2 == 1
    quote &= ~odd[rows]
    inquote = (np.where(odd[rows], 0, parity) % 2 == 1) | quote

    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[start[:-1][ends]] = True
    last[start[1:][ends] - 1] = True
    prev_digit = np.concatenate([[False], digit[:-1]]) & ~first
    next_digit = np.concatenate([digit[1:], [False]]) & ~last
    # numbering: a run of digits after a space or the start, then . or ), then a space; it counts up from 1
    opens, closes = _among(cp, OPEN) & ~inquote, _among(cp, CLOSE) & ~inquote
    mark = ((cp == 46) | (cp == 41) | (cp == 0xFF0E) | (cp == 0xFF09)) & prev_digit & np.concatenate([space[1:], [False]]) & ~last & ~inquote
    at = np.flatnonzero(mark)
    numbers: list[tuple[int, int]] = []
    if len(at):
        nondigit = np.where(digit, -1, np.arange(n))
        before = np.maximum.accumulate(np.where(first & digit, np.arange(n) - 1, nondigit))[at - 1]
        free = (before < start[rows[at]]) | space[np.maximum(before, 0)]
        at, before = at[free], before[free]
        lead = np.minimum.reduceat(np.append(np.where(space, n, np.arange(n)), n), np.minimum(start[:-1], n))
        open_ = _running(opens.astype(np.int64) - closes, start)
        row, due, taken = -1, 0, 0
        for i, j, r, level in zip(before.tolist(), at.tolist(), rows[at].tolist(), open_[at - 1].tolist(), strict=True):
            if r != row:
                row, due, taken = r, 1 if i + 1 == lead[r] else 0, 0
            # a bracket that is open here is closed by the mark; marks of numbers before count as closed ones
            value = 0
            for c in cp[i + 1 : j].tolist() if j - i < 12 else ():
                value = value * 10 + c - 48
            if due and value == due and level + taken <= 0:
                numbers.append((i + 1, j + 1))
                due += 1
                taken += int(closes[j])
    for i, j in numbers:
        closes[j - 1] = False
    depth = _running(opens.astype(np.int64) - closes, start)
    bad = np.zeros(nrow, bool)
    bad[ends] = depth[start[1:][ends] - 1] != 0
    np.logical_or.at(bad, rows[depth < 0], True)
    inside = inquote | (((depth > 0) | closes) & ~bad[rows])
    delim = _among(cp, DELIMITERS) & ~inside & ~(prev_digit & next_digit)
    delim |= (cp >= 0x2460) & (cp <= 0x2473) & ~inside
    for i, j in numbers:
        delim[i:j] = True

    # one closing full stop of the whole string
    solid = ~space & ~delim
    tail = np.full(nrow, -1, np.int64)
    idx = np.flatnonzero(~space)
    tail[rows[idx]] = idx  # the last write wins: the last solid character
    tail = tail[tail >= 0]
    stop = tail[_among(cp[tail], STOPS) & ~inside[tail]]
    delim[stop] = True
    solid[stop] = False

    # spans between delimiters, trimmed
    span = np.cumsum(delim | first) + 0
    idx = np.flatnonzero(solid)
    if not len(idx):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.string())
    s = span[idx]
    cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    lo, hi = idx[cut], np.append(idx[cut[1:] - 1], idx[-1]) + 1
    # enclosing quotes
    for _ in range(2):
        a, z = cp[lo], cp[hi - 1]
        wide = hi - lo >= 2
        ascii_pair = wide & (a == 34) & (z == 34) & quote[lo]
        pair = np.zeros(len(lo), bool)
        for o, c in zip(QUOTES_OPEN, QUOTES_CLOSE, strict=True):
            pair |= wide & (a == ord(o)) & (z == ord(c)) & ~bad[rows[lo]]
        # the quote closes only at the end: depth doesn't fall to zero earlier
        if pair.any():
            zero = np.zeros(n + 1, np.int64)
            np.cumsum((depth == 0) & ~inquote, out=zero[1:])
            base = depth[lo] == 1
            pair &= ~base | (zero[hi - 1] - zero[lo] == 0)
        lo, hi = lo + (ascii_pair | pair), hi - (ascii_pair | pair)
        keep = hi > lo
        lo, hi = lo[keep], hi[keep]
        # trim again inside the quotes
        while len(lo) and (m := space[lo] & (hi > lo)).any():
            lo = lo + m
            lo, hi = lo[hi > lo], hi[hi > lo]
        while len(lo) and (m := space[hi - 1]).any():
            hi = hi - m
    keep = hi > lo
    lo, hi = lo[keep], hi[keep]
    parent = rows[lo]
    fresh = np.concatenate([[True], parent[1:] != parent[:-1]]) if len(parent) else np.zeros(0, bool)
    pos = np.arange(len(parent)) - np.maximum.accumulate(np.where(fresh, np.arange(len(parent)), 0)) + 1
    # gather the values, dropping the second of a doubled quote
    size = hi - lo
    offs = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    take = np.repeat(lo - offs[:-1], size) + np.arange(offs[-1])
    out = cp[take]
    mark = out == 34
    head = np.zeros(len(out), bool)
    head[offs[:-1]] = True
    at = np.arange(len(out))
    run = at - np.maximum.accumulate(np.where(~mark, at, np.where(head, at - 1, -1)))
    twin = mark & (run % 2 == 0) & (run > 0)
    upto = np.zeros(len(out) + 1, np.int64)
    np.cumsum(~twin, out=upto[1:])
    return parent, pos.astype(np.int32), to_strings(out[~twin], upto[offs])


def split_values(df: DataFrame, min_values: int = 1) -> DataFrame:
    """Split ``text`` of (field, row_id, elem, text) rows; rows with fewer values are left out."""
    small = df.select("field", F.col("row_id").cast("bigint").alias("row_id"), F.col("elem").cast("int").alias("elem"), "text").filter("text is not null and text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, pos, val = split_block(batch.column(3))
            count = np.bincount(parent, minlength=batch.num_rows)
            keep = np.flatnonzero(count[parent] >= min_values)
            p = pa.array(parent[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(p), batch.column(1).take(p), batch.column(2).take(p), pa.array(pos[keep]), val.take(pa.array(keep))], names=["field", "row_id", "elem", "pos", "val"])

    return small.mapInArrow(run, SCHEMA)
