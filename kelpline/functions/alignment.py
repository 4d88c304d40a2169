"""The score by which an item of a record and a finding are aligned."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from .distance import weighted_distance
from .text import LOOKALIKE, VARIANTS

_SPACE, _DOTS = re.compile(r"\s+"), re.compile("[·・･]")
_BRACKETS, _SEPARATORS = re.compile(r"[()（）\[\]【】「」『』〈〉]"), re.compile("[·・･/／,、，]")
_FOLD = str.maketrans(*(a + b for a, b in zip(VARIANTS, LOOKALIKE, strict=True)))


def _surface(s: str) -> str:
    return _DOTS.sub("", _SPACE.sub("", unicodedata.normalize("NFKC", s))).lower()


@lru_cache(100_000)
def _forms(s: str) -> tuple[str, str, str, str, str]:
    """Surface, core (before the bracket), loose (flat and folded), flat, and the part before any bracket."""
    head = re.split("[(（]", s, maxsplit=1)[0]
    surface = _surface(s)
    flat = _SEPARATORS.sub("", _BRACKETS.sub("", surface))
    return surface, _surface(head or s), flat.translate(_FOLD), flat, head


def _edit_similarity(a: str, b: str) -> float:
    """The plain similarity; 0 where lengths and characters rule out 0.65."""
    n = max(len(a), len(b))
    if n - sum((Counter(a) & Counter(b)).values()) > 0.35 * n + 1e-9:
        return 0.0
    return 1 - weighted_distance(a, b, {}) / n


def pair_score(item: str, found: str) -> float:
    """1 for equal texts, then by class: equal before the bracket, equal joined, prefix, substring, common prefix or edits.

    A finding that is only in the brackets of an item scores 0.3.
    """
    gn, gc, gl, gf, head = _forms(item)
    fn, fc, fl, ff, _ = _forms(found)
    if gn == fn:
        return 1.0
    pairs = [(a, b) for a, b in ((gc, fc), (gl, fl), (gf, ff)) if a and b]
    for (a, b), equal in zip(((gc, fc), (gl, fl), (gf, ff)), (0.98, 0.97, 0.96), strict=True):
        if a and a == b:
            return equal
    for (a, b), prefix in zip(((gc, fc), (gl, fl), (gf, ff)), (0.94, 0.92, 0.9), strict=True):
        if a and b and (a.startswith(b) or b.startswith(a)):
            return prefix + 0.01 * min(len(a), len(b)) / max(len(a), len(b))
    sub = max((0.78 + 0.08 * min(len(a), len(b)) / max(len(a), len(b)) for a, b in pairs if a in b or b in a), default=0.0)
    if sub:
        h = _forms(head)
        heads = [x for x in h[:4] if x]
        if all(len(c) >= 2 and not any(c in x or x in c for x in heads) for c in (fn, fc, ff, fl) if c):
            return 0.3
        return min(sub, 0.9)
    best = 0.0
    for a, b in pairs:
        p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        if p >= 3:
            best = max(best, 0.6 + 0.35 * p / min(len(a), len(b)))
        if (s := _edit_similarity(a, b)) >= 0.65:
            best = max(best, 0.85 * s)
    return best


def alignment_score(item: Column, *found: Column) -> Column:
    """The best pair score of an item over the texts of a finding; nulls and empty texts count nothing."""

    @F.pandas_udf(DoubleType())
    def f(a: pd.Series, *b: pd.Series) -> pd.Series:
        return pd.Series([max((pair_score(x, y) for y in ys if x and y), default=0.0) for x, *ys in zip(a, *b, strict=True)], dtype="float64")

    return f(item, *found)


def _within(text: str, part: str) -> bool:
    """Whether a text holds a part of two characters or more, one of four or more with one edit."""
    if len(part) < 2 or not text:
        return False
    if part in text or len(part) < 4:
        return part in text
    # the least distance of the part to any stretch of the text that ends at each place
    row = [0] * (len(text) + 1)
    for i, x in enumerate(part, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > 1:
            return False
    return True


def is_part(item: str, found: str) -> bool:
    """Whether a finding is part of an item, or the item of it, in any of their forms."""
    gn, gc, gl, gf, _ = _forms(item)
    fn, _, fl, ff, _ = _forms(found)
    del gn
    return any(_within(a, b) or _within(b, a) for a in (gc, gf, gl) for b in (ff, fl, fn))


def part_of(item: Column, *found: Column) -> Column:
    """Whether any text of a finding is part of the item; nulls and empty texts are none."""

    @F.pandas_udf(BooleanType())
    def f(a: pd.Series, *b: pd.Series) -> pd.Series:
        return pd.Series([any(is_part(x, y) for y in ys if x and y) for x, *ys in zip(a, *b, strict=True)], dtype="bool")

    return f(item, *found)
