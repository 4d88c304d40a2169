"""Mapping freely entered values to a canonical list.

Values are deduplicated, brought to plain characters, and stripped of amounts, marks and remarks.
Candidates come from an inverted index of character bigrams and trigrams over the list's spellings, scored
by cosine with inverse-document-frequency weights. The best candidate is accepted above a threshold, fitted for each
length on slips laid on the list's own spellings, and with a margin over the best one of another term. An exact check by
edit distance (with swaps) of every spelling above the threshold goes before: length, shared n-grams and character counts
only rule out what can't pass it.

What stands before or after names as a remark, and how the words for a form are shortened, is learnt from the values: what
is left of them beside a spelling, or beside a raw material, if many different raw materials have it.

The list is split into raw material and form, so that the index also holds mixed spellings, turned-round
ones and combinations that are *not* in the list: a value nearer to one of those means no term.

Defined results: null, empty and remark-only values are unmatched; ties between terms are unmatched; a
value equal to a canonical spelling is matched with score 1; repeated values get equal results; of an
overlong value all n-grams count (its cosine is low). An empty list matches nothing.
The list must stay small (``MAX_TERMS``): it is broadcast, and a longer one is refused.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hot_join import hot_join
from ..session import checkpointed, spread_small
from .unify import unify_column

MAX_TERMS = 100_000
#: The share of slips laid on the list that may fall below the threshold, the slips tried for a length, and the least lead in cosine over
#: another term.
MISSED, SLIPS, MARGIN = 0.002, 1000, 0.02
#: A remark or a shortened form stands beside so many raw materials, this share of them, and in this share of the values that the most
#: common one of its kind is in, at least: slips are rarer.
BESIDE, SHARE, RARER = 3, 0.05, 0.05
#: Remarks of this length may have a slip.
LONG = 6
#: Bigrams and trigrams of a key that one edit can touch (a swap touches three and four); buckets of counted characters.
TOUCHED, BUCKETS = 7, 64
_BRACKETS = re.compile(r"[(\[{（［【][^)\]}）］】]*[)\]}）］】]s?")
_WHOLE = {("(", ")"), ("[", "]"), ("「", "」"), ("（", "）"), ('"', '"')}
_AMOUNT = re.compile(r"\*+\d*s?|\d+(?:[.,]\d+)*\s*(?:%|mg|kg|ml|g)?s?(?![a-z])")
_HIRAGANA = {c: c - 0x60 for c in range(0x30A1, 0x30F7)}
_NONWORD = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Learnt:
    """Remarks before and after names, and shortened words for forms with the form they stand for."""

    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    short: tuple[tuple[str, str], ...] = ()


def stripped(v: str) -> str:
    """A plain value in lower case and hiragana, without amounts, marks and bracketed remarks."""
    v = v.strip()
    if len(v) > 2 and (v[0], v[-1]) in _WHOLE:
        v = v[1:-1]
    v = re.sub(r"[._]+(?=\w)", " ", _AMOUNT.sub(" ", _BRACKETS.sub(" ", v.lower()))).strip(" -・.,;:*。、\"'")
    return v.translate(_HIRAGANA).strip()


def key_of(v: str) -> str:
    """The letters and digits of a stripped value."""
    return _NONWORD.sub("", stripped(v))


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or most + 1 if it is larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        row = [i] + [most + 1] * len(b)
        for j in range(lo, hi + 1):
            y = b[j - 1]
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row[j] = v
        if min(row[lo : hi + 1], default=0) > most:
            return most + 1
        two, one = one, row
    return min(one[len(b)], most + 1)


def allowed(n: int, kanji: bool) -> int:
    """The largest edit distance for a key of n characters."""
    if kanji:
        return 0 if n < 4 else 1
    return 0 if n < 4 else 1 if n < 6 else 2 if n < 16 else 3


def _grams(key: str) -> list[str]:
    s = f"^{key}$"
    return list({*(a + b for a, b in pairwise(s)), *(s[i : i + 3] for i in range(len(s) - 2))})


def _bag(key: str) -> np.ndarray:
    return np.bincount([ord(c) % BUCKETS for c in key], minlength=BUCKETS)


class Index:
    """The inverted n-gram index over all spellings of (term_id, term, term_ja, reading, romaji) rows."""

    def __init__(self, terms: list[tuple], learnt: Learnt = Learnt(), fitted: bool = True):
        self.before: dict[str, list[str]] = defaultdict(list)
        self.after: dict[str, list[str]] = defaultdict(list)
        for w in learnt.before:
            self.before[w[0]].append(w)
        for w in learnt.after:
            self.after[w[-1]].append(w)
        self.exact: dict[str, int] = {}
        by_form: dict[str, list[tuple]] = defaultdict(list)
        ends = _common_ends([t[1] for t in terms if t[1]])
        for t in terms:
            for s in t[1:]:
                if s:
                    self.exact.setdefault(s, t[0])
            if all(t[1:]):
                by_form[_ending(t[1], ends)].append(t)
        keys: dict[str, int] = {}
        tight: set[str] = set()
        self.parts: dict[int, tuple] = {}
        self.forms: dict[str, tuple] = {}
        for form, group in by_form.items():
            if not form or len(group) < 2:
                continue
            tails = (form, *(_tail([t[k] for t in group]) for k in (2, 3, 4)))
            self.forms[form] = tails
            for t in group:
                self.parts[t[0]] = tuple(s[: len(s) - len(e)].strip() for s, e in zip(t[1:], tails, strict=True))
        for t in terms:
            for s in t[1:]:
                if s:
                    keys.setdefault(key_of(s), t[0])
        self.listed = dict(keys)
        self.mains = {key_of(p[0]) for p in self.parts.values()}
        short: dict[str, list[str]] = defaultdict(list)
        for w, f in learnt.short:
            short[f].append(w)
        listed = {(self.parts[t[0]][0], _ending(t[1], ends)) for t in terms if t[0] in self.parts}
        mains = {p[0]: p for p in self.parts.values()}
        for t in terms:
            if t[0] in self.parts:
                form = _ending(t[1], ends)
                self._spell(keys, tight, self.parts[t[0]], self.forms[form], t[0], short[form])
        for b, p in mains.items():
            for f, tails in self.forms.items():
                if (b, f) not in listed:
                    self._spell(keys, tight, p, tails, -1, [])
        self.keys = list(keys)
        self.most = np.array([1 if k in tight else 9 for k in self.keys], np.int32)
        self.term = np.array([keys[k] for k in self.keys], np.int64)
        self.at = {k: i for i, k in enumerate(self.keys)}
        posts: dict[str, list[int]] = defaultdict(list)
        for i, k in enumerate(self.keys):
            for g in _grams(k):
                posts[g].append(i)
        n = max(1, len(self.keys))
        self.idf = {g: float(np.log(1 + n / len(p))) for g, p in posts.items()}
        self.posts = {g: np.array(p, np.int32) for g, p in posts.items()}
        self.norm = np.array([np.sqrt(sum(self.idf[g] ** 2 for g in _grams(k))) for k in self.keys])
        self.rare = float(np.log(1 + n))
        self.length = np.array([len(k) for k in self.keys], np.int32)
        self.grams = np.array([len(_grams(k)) for k in self.keys], np.int32)
        self.bags = np.array([_bag(k) for k in self.keys], np.int16).reshape(-1, BUCKETS)
        self.thresholds = self._fitted() if fitted else [1.0]

    def _fitted(self) -> list[float]:
        """For each length the cosine that all but MISSED of the allowed slips on spellings of that length keep."""
        rng = random.Random(4)
        by_size: dict[int, list[str]] = defaultdict(list)
        for k in self.listed:
            by_size[len(k)].append(k)
        out, last = [0.0], 0.0
        for size in range(1, max(by_size, default=0) + 1):
            if by_size[size]:
                cosines = []
                for _ in range(SLIPS):
                    k = rng.choice(by_size[size])
                    x = _slipped(k, max(1, allowed(len(k), _has_kanji(k))), rng)
                    mine, other = set(_grams(k)), set(_grams(x))
                    size_x = sum(self.idf.get(g, self.rare) ** 2 for g in other) ** 0.5
                    cosines.append(sum(self.idf[g] ** 2 for g in mine & other) / size_x / self.norm[self.at[k]])
                last = float(np.quantile(cosines, MISSED))
            out.append(last)
        return out

    def threshold(self, size: int) -> float:
        """The least cosine of a key of so many characters."""
        return self.thresholds[min(size, len(self.thresholds) - 1)]

    @staticmethod
    def _spell(keys: dict[str, int], tight: set[str], p: tuple, f: tuple, term: int, short: list[str]) -> None:
        forms = [p[0] + f[0], p[1] + f[1], p[2] + f[2], p[3] + f[3], p[1] + f[2], p[2] + f[1], p[1] + "の" + f[1], p[2] + "の" + f[1]]
        forms += [f[0] + p[0], f[0] + "of" + p[0], f[0] + "from" + p[0], f[3] + p[3]]
        # shortened forms leave little room for slips: they are noted in ``tight``
        less = [x for a in short for x in (p[0] + a, a + p[0], a + "of" + p[0], a + "from" + p[0])]
        tight |= {key_of(x) for x in less}
        for s in forms + less:
            keys.setdefault(key_of(s), term)

    def _possible(self, key: str, grams: int, posts: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """All spellings above the threshold, without those that can't be within their edit distance of a key."""
        i = np.flatnonzero(score >= self.threshold(len(key)))
        near = np.minimum(most, self.most[i])
        ok = np.abs(self.length[i] - len(key)) <= near
        i, near = i[ok], near[ok]
        if len(i) > 16:
            shared = np.bincount(posts, minlength=len(self.keys))[i]
            ok = np.maximum(self.grams[i], grams) - shared <= TOUCHED * near
            i, near = i[ok], near[ok]
        # a substitution changes two counts, a swap none
        return i[np.abs(self.bags[i] - _bag(key)).sum(1) <= 2 * near]

    def _tries(self, key: str) -> list[str]:
        """A key, and what is left of it without each remark it begins or ends with, with a slip in a long one."""
        tries, fresh = {key: None}, [key]
        while fresh:
            x, found = fresh.pop(), []
            for w in self.before.get(x[:1], ()):
                slips = len(w) >= LONG
                for n in (len(w) - 1, len(w), len(w) + 1) if slips else (len(w),):
                    if n < len(x) and (x.startswith(w) or (slips and osa(x[:n], w, 1) <= 1)):
                        found.append(x[n:])
            found += [x[: -len(w)] for w in self.after.get(x[-1:], ()) if len(w) < len(x) and x.endswith(w)]
            fresh += [y for y in found if y not in tries]
            tries |= dict.fromkeys(found)
        return list(tries)

    def find(self, value: str, memo: dict[str, tuple[int, float, int]] | None = None) -> tuple[int, float, int]:
        """(term or -1, cosine, edit distance) of one plain value; ``memo`` keeps the results of keys."""
        key = key_of(value)
        if not key:
            return -1, 0.0, -1
        memo = {} if memo is None else memo
        if key not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[key] = self._found(key)
        return memo[key]

    def _found(self, key: str) -> tuple[int, float, int]:
        tries = self._tries(key)
        for k in tries:
            if (i := self.at.get(k)) is not None:
                return int(self.term[i]), 1.0, 0
        best: dict[int, tuple[float, int]] = {}
        for k in tries:
            grams = [g for g in _grams(k)]
            known = [g for g in grams if g in self.posts]
            if not known:
                continue
            w = np.array([self.idf[g] for g in known])
            size = np.array([len(self.posts[g]) for g in known])
            posts = np.concatenate([self.posts[g] for g in known])
            score = np.bincount(posts, np.repeat(w * w, size), len(self.keys))
            length = np.sqrt((w * w).sum() + (len(grams) - len(known)) * self.rare**2)
            score /= self.norm * length
            most = allowed(len(k), _has_kanji(k))
            for i in self._possible(k, len(grams), posts, score, most):
                near = min(most, int(self.most[i]))
                d = osa(k, self.keys[i], near)
                if d <= near:
                    t = int(self.term[i])
                    got = (-float(score[i]), d)
                    if t not in best or got < best[t]:
                        best[t] = got
        if not best:
            return -1, 0.0, -1
        order = sorted(best.items(), key=lambda x: (x[1], x[0]))
        t, (s, d) = order[0]
        if len(order) > 1 and order[1][1][0] - s < MARGIN:
            return -1, -s, d
        return t, -s, d


def _has_kanji(k: str) -> bool:
    return not k.isascii() and any(c > "㐀" for c in k)


def _slipped(k: str, n: int, rng: random.Random) -> str:
    """A key with n slips: a character lost, doubled, swapped or mistaken."""
    for _ in range(n):
        i = rng.randrange(len(k))
        k = rng.choice([k[:i] + k[i + 1 :], k[:i] + k[i] + k[i:], k[:i] + k[i : i + 2][::-1] + k[i + 2 :], k[:i] + rng.choice(k) + k[i + 1 :]]) or k
    return k


def _common_ends(names: list[str]) -> set[str]:
    """Last words, or last two where a last word always follows the same word, shared by several names."""
    last: dict[str, set[str]] = defaultdict(set)
    for n in names:
        w = n.split()
        if len(w) > 1:
            last[w[-1]].add(w[-2])
    out = set()
    for w, before in last.items():
        same = len(before) == 1 and sum(n.endswith(" " + w) for n in names) > 1
        out.add(f"{next(iter(before))} {w}" if same else w)
    return out


def _ending(name: str, ends: set[str]) -> str:
    w = name.split()
    two = " ".join(w[-2:])
    return two if len(w) > 2 and two in ends else w[-1] if len(w) > 1 and w[-1] in ends else ""


def _tail(names: list[str]) -> str:
    """The longest common ending."""
    out = names[0]
    for n in names[1:]:
        while not n.endswith(out):
            out = out[1:]
    return out


def _beside(index: Index, key: str) -> list[tuple[str, str, str]]:
    """(kind, what, raw material) of what is left of a key beside a spelling of the list, or beside a raw material."""
    out = []
    if key in index.listed:
        return out
    for i in range(1, len(key)):
        for kind, spelled, rest in (("before", key[i:], key[:i]), ("after", key[:i], key[i:])):
            if len(spelled) > 2 and (t := index.listed.get(spelled)) is not None and t in index.parts:
                out.append((kind, rest, index.parts[t][0]))
        if key[:i] in index.mains:
            out.append(("form", key[i:], key[:i]))
    return out


def shortened(word: str, forms: list[str]) -> str | None:
    """The one form that a word shortens (letters left out, or vowels put otherwise); none for a form with a slip, which needs no spelling."""
    if any(osa(word, f.replace(" ", ""), 1) <= 1 for f in forms):
        return None
    begins = lambda f: f[:1] == word[:1]
    for test in (lambda f: f.startswith(word), lambda f: begins(f) and _inside(word, f), lambda f: begins(f) and len(_bones(word)) > 1 and _inside(_bones(word), _bones(f))):
        fits = [f for f in forms if test(f.replace(" ", ""))]
        if fits:
            return fits[0] if len(fits) == 1 else None
    return None


def _inside(a: str, b: str) -> bool:
    rest = iter(b)
    return all(c in rest for c in a)


def _bones(w: str) -> str:
    return "".join(c for c in w if c not in "aeiou")


def learn(distinct: DataFrame, terms: list[tuple], column: str = "val") -> Learnt:
    """Remarks and shortened forms that stand beside many raw materials, by counts over all distinct values."""
    index = Index(terms, fitted=False)
    mains = len({p[0] for p in index.parts.values()})
    if not mains:
        return Learnt()
    shared = distinct.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, _ = unify_column(batch.column(0))
            found = Counter(x for v in plain.to_pylist() for x in _beside(shared.value, key_of(v)))
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in found], pa.string()) for k in range(3)), pa.array(list(found.values()), pa.int64())], names=["kind", "what", "main", "n"])

    by_main = distinct.select(column).mapInArrow(run, "kind string, what string, main string, n bigint").groupBy("kind", "what", "main").agg(F.sum("n").alias("n"))
    counts = by_main.groupBy("kind", "what").agg(F.count("*").alias("mains"), F.sum("n").alias("n")).filter(F.col("mains") >= max(BESIDE, SHARE * mains))
    # as many as there are words that go with a twentieth of the list: few, and refused if not
    rows = counts.orderBy("kind", "what").limit(MAX_TERMS).collect()
    if len(rows) == MAX_TERMS:
        raise ValueError("too many remarks")
    forms = sorted(index.forms)
    top = {k: max((r.n for r in rows if r.kind == k), default=0) for k in ("before", "after", "form")}
    rows = [r for r in rows if r.n >= RARER * top[r.kind]]
    known = {f.replace(" ", "") for f in forms}
    short = {r.what: shortened(r.what, forms) for r in rows if r.kind == "form" and r.what not in known}
    return Learnt(*(tuple(r.what for r in rows if r.kind == k) for k in ("before", "after")), tuple((w, f) for w, f in short.items() if f))


def mapped_values(values: DataFrame, terms: DataFrame, column: str = "val") -> DataFrame:
    """(val, n, term_id, score, edits) of every distinct value; term_id is null for unmatched ones."""
    if terms.count() > MAX_TERMS:
        raise ValueError(f"the canonical list has more than {MAX_TERMS} terms")
    rows = [tuple(r) for r in terms.select("term_id", "term", "term_ja", "reading", "romaji").collect()]
    # one round-robin shuffle of the distinct values, so that matching uses all cores
    distinct = checkpointed(spread_small(values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("val")).agg(F.count("*").alias("n"))))
    shared = values.sparkSession.sparkContext.broadcast(Index(rows, learn(distinct, rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = shared.value, {}
        for batch in batches:
            plain, _ = unify_column(batch.column(0))
            got = [(index.exact[r], 1.0, 0) if r in index.exact else index.find(p, memo) for r, p in zip(batch.column(0).to_pylist(), plain.to_pylist(), strict=True)]
            term = pa.array([g[0] if g[0] >= 0 else None for g in got], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), term, pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int32())], names=["val", "n", "term_id", "score", "edits"])

    return distinct.mapInArrow(run, "val string, n bigint, term_id int, score double, edits int")


def mapped_rows(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(field, row_id, pos, val, term_id, score) of every value that means a term."""
    values = values.select("field", "row_id", "pos", "val")
    found = checkpointed(mapped_values(values, terms).filter("term_id is not null"))
    return hot_join(values, found.drop("edits"), "val", "n", values.count()).drop("n")


def spelled_otherwise(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(field, row_id, pos, term_id) of the values that mean a term but aren't one of its spellings."""
    names = terms.select(F.explode(F.array("term", "term_ja", "reading", "romaji")).alias("val")).filter("val is not null").distinct()
    return mapped_rows(values, terms).join(F.broadcast(names), "val", "left_anti").select("field", "row_id", "pos", "term_id")
