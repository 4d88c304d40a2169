"""String distances: weighted edit distance as an Arrow function; the plain one is built in."""

from __future__ import annotations

import unicodedata
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# What it costs to take a small kana for a large one, a voiced one for an unvoiced one, and a shape for a like one.
SMALL, VOICED, SHAPE = 0.25, 0.3, 0.3
# Characters of one shape class that scanners take for each other.
SHAPES = ("シツ", "ソン", "カ力", "エ工", "ロ口", "タ夕", "ミ三", "ー一")


def _kana() -> list[tuple[str, float]]:
    """Katakana that differ in size or in voicing marks alone, by their Unicode names and decompositions."""
    large = [(c, unicodedata.name(chr(c)).replace("LETTER SMALL", "LETTER")) for c in range(0x30A1, 0x30FB) if "LETTER SMALL" in unicodedata.name(chr(c))]
    marked: dict[str, str] = {}
    for c in range(0x30A1, 0x30FB):
        plain = unicodedata.normalize("NFD", chr(c))[0]
        marked[plain] = marked.get(plain, plain) + (chr(c) if chr(c) != plain else "")
    return [(chr(c) + unicodedata.lookup(name), SMALL) for c, name in large] + [(g, VOICED) for g in marked.values() if len(g) > 1]


#: Groups of characters that scanners mix up, with the cost of a substitution inside a group; callers may pass their own.
GROUPS: list[tuple[str, float]] = _kana() + [(g, SHAPE) for g in SHAPES]


def costs(groups: list[tuple[str, float]] | None = None) -> dict[tuple[str, str], float]:
    """The symmetric substitution costs of all pairs in each group; a later group overrides an earlier one."""
    out: dict[tuple[str, str], float] = {}
    for chars, cost in GROUPS if groups is None else groups:
        for a, b in combinations(chars, 2):
            out[a, b] = out[b, a] = cost
    return out


def weighted_distance(a: str, b: str, cost: dict[tuple[str, str], float]) -> float:
    """Edit distance with substitution costs; insertion and deletion cost 1."""
    if len(a) < len(b):
        a, b = b, a
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = min(row[j] + 1, row[j - 1] + 1, last + (0.0 if x == y else cost.get((x, y), 1.0)))
            last = keep
    return row[-1]


def _padded(rows: list[str], width: int) -> np.ndarray:
    """Code points of strings, one row each, filled up with zeros."""
    return np.frombuffer("".join(x.ljust(width, "\0") for x in rows).encode("utf-32-le", "replace"), np.uint32).reshape(len(rows), width)


def weighted_distances(a: list[str], b: list[str], cost: dict[tuple[str, str], float]) -> np.ndarray:
    """The weighted distance of many pairs: the same table as for one pair, each of its cells computed for all pairs at once.

    Pairs of like size are handled together, so that little is computed for padding.
    """
    chars = sorted({c for k in cost for c in k})
    known = np.array([ord(c) for c in chars], np.uint32)
    swap = np.ones((len(chars) + 1, len(chars) + 1))
    at = {c: i for i, c in enumerate(chars)}
    for (x, y), v in cost.items():
        swap[at[x], at[y]] = v

    def place(x: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(x.shape, np.int64)
        i = np.minimum(np.searchsorted(known, x), len(known) - 1)
        return np.where(known[i] == x, i, len(known))

    na, nb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    out = np.zeros(len(a))
    size = np.maximum(na, nb)
    order = np.argsort(size, kind="stable")
    start = 0
    while start < len(order):
        # a block of like sizes, smaller for long strings
        width = max(1, int(size[order[min(start + 4096, len(order)) - 1]]))
        block = order[start : start + max(1, min(4096, 4_000_000 // width))]
        start += len(block)
        la, lb = na[block], nb[block]
        wa, wb = int(la.max()), int(lb.max())
        if not wa or not wb:
            out[block] = np.maximum(la, lb)
            continue
        x, y = _padded([a[i] for i in block], wa), _padded([b[i] for i in block], wb)
        px, py = place(x), place(y)
        row = np.tile(np.arange(wb + 1, dtype=np.float64)[:, None], (1, len(block)))
        done = np.where(la == 0, lb.astype(np.float64), 0.0)
        for i in range(wa):
            last, new = row, np.empty_like(row)
            new[0] = i + 1
            for j in range(wb):
                sub = np.where(x[:, i] == y[:, j], 0.0, swap[px[:, i], py[:, j]])
                new[j + 1] = np.minimum(np.minimum(last[j + 1], new[j]) + 1, last[j] + sub)
            row = new
            ends = np.flatnonzero(la == i + 1)
            done[ends] = row[lb[ends], ends]
        out[block] = done
    return out


def weighted_similarity(left: Column, right: Column, groups: list[tuple[str, float]] | None = None) -> Column:
    """1 minus the weighted distance over the longer length; 1 for two empty strings; null for a null."""
    table = costs(groups)

    @F.pandas_udf(DoubleType())
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        null = (a.isna() | b.isna()).to_numpy()
        x, y = a.fillna("").tolist(), b.fillna("").tolist()
        n = np.maximum([len(s) for s in x], [len(s) for s in y]) if len(x) else np.zeros(0)
        out = 1.0 - weighted_distances(x, y, table) / np.maximum(n, 1)
        out[null] = np.nan
        return pd.Series(out).astype("Float64").where(~null, None).astype("object")

    return f(left, right)


def folds(groups: list[tuple[str, float]] | None = None) -> dict[str, str]:
    """One character for all that groups connect."""
    to: dict[str, str] = {}
    for chars, _ in GROUPS if groups is None else groups:
        reps = {to.get(x, x) for x in chars}
        to |= {x: min(reps) for x in {*chars, *reps, *(k for k, v in to.items() if v in reps)}}
    return {k: v for k, v in to.items() if k != v}


def folded(c: Column, groups: list[tuple[str, float]] | None = None) -> Column:
    """A string with one character for all that groups connect: the plain distance of two such is never above the weighted one."""
    moved = folds(groups)
    return F.translate(c, "".join(moved), "".join(moved.values())) if moved else c


def characters(c: Column) -> Column:
    """Which of 64 buckets the characters of a string fall into, as bits; strings lacking k of each other's bits are k edits apart."""
    return F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.when(x == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(x), F.lit(64)).cast("int")))))


def similarity(left: Column, right: Column) -> Column:
    """1 minus the plain edit distance over the longer length; 1 for two empty strings."""
    n = F.greatest(F.length(left), F.length(right))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(left, right) / n)


def pure_indel(left: Column, right: Column) -> Column:
    """The strings differ by insertions (or deletions) alone."""
    return F.levenshtein(left, right) == F.abs(F.length(left) - F.length(right))
