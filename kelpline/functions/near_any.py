"""Whether a string is near any of many others, at similarities so low that no part of it is sure to be shared.

Exact: a pair is ruled out by bounds alone only if its distance is sure to be too large, and decided by the weighted distance
otherwise. What saves the time is that one near string is enough, and that those with most characters in common are tried first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .distance import weighted_distances

#: Strings that are indexed at a time; how many of the likeliest are tried first; pairs of small groups that are compared at a time.
BLOCK, FIRST, PAIRS = 1 << 16, 16, 1 << 19
#: A feature of more than this share of the strings is kept as a row of all of them.
DENSE = 1 / 32

Cost = dict[tuple[str, str], float]


def gates(terms: list[str], least: float, least_short: float) -> np.ndarray:
    """The least similarity of each term: another one up to three characters."""
    return np.array([least_short if len(t) <= 3 else least for t in terms], np.float64)


def _near(a: list[str], b: list[str], gate: np.ndarray, cost: Cost) -> np.ndarray:
    """Whether pairs are similar enough, both strings being of one character or more."""
    n = np.maximum([len(x) for x in a], [len(x) for x in b])
    return 1.0 - weighted_distances(a, b, cost) / np.maximum(n, 1) >= gate


def _points(forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of strings one after another, the string of each, and the lengths."""
    lens = np.array([len(f) for f in forms], np.int64)
    return np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.repeat(np.arange(len(forms)), lens), lens


def _distances(size: np.ndarray, lens: np.ndarray, same: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """The plain distances of pairs sorted by the length of the second string: all columns of a table as bits of one word.

    ``size``: the lengths of the first strings, from 1 to 64; ``same``: from a pair on, where the first string has the n-th character of the second one.
    """
    one, out = np.uint64(1), np.zeros(len(lens), np.int64)
    whole = np.uint64(2**64 - 1) >> (64 - size).astype(np.uint64)
    plus, minus = np.full(len(lens), 2**64 - 1, np.uint64), np.zeros(len(lens), np.uint64)
    ends = np.searchsorted(lens, np.arange(int(lens[-1]) + 1 if len(lens) else 0), "right")
    for j in range(len(ends) - 1):
        lo, hi = int(ends[j]), int(ends[j + 1])
        eq = same(j, lo)
        up = (((eq & plus) + plus) ^ plus) | eq
        high, low = minus | ~(up | plus), plus & up
        high = (high << one) | one
        eq |= minus
        plus, minus = (low << one) | ~(eq | high), high & eq
        if hi > lo:
            out[lo:hi] = j + 1 + np.bitwise_count(plus[: hi - lo] & whole[lo:hi]).astype(np.int64) - np.bitwise_count(minus[: hi - lo] & whole[lo:hi])
            plus, minus = plus[hi - lo :], minus[hi - lo :]
    return out


class Index:
    """Strings by their characters: the k-th one of a kind is a feature, so features in common are characters in common."""

    def __init__(self, forms: list[str]) -> None:
        lens = np.array([len(f) for f in forms], np.int64)
        self.order = np.argsort(lens, kind="stable")
        self.lens = lens[self.order]
        self.forms = [forms[i] for i in self.order]
        n = len(forms)
        points, owner, _ = _points(self.forms)
        known, ids = np.unique(points, return_inverse=True)
        self.place = {chr(c): i for i, c in enumerate(known.tolist())}
        self.text, self.start = ids.astype(np.int32), np.cumsum(self.lens) - self.lens
        by = np.lexsort((points, owner))
        p, o = points[by], owner[by]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1])
        start = np.flatnonzero(new)
        key = p << 32 | (np.arange(len(p)) - np.repeat(start, np.diff(np.append(start, len(p)))))
        by = np.argsort(key, kind="stable")
        keys, at = np.unique(key[by], return_index=True)
        self.kind = np.uint8 if n and self.lens[-1] < 256 else np.int32
        self.rows: dict[int, np.ndarray] = {}
        self.posts: dict[int, np.ndarray] = {}
        for k, post in zip(keys.tolist(), np.split(o[by], at[1:]), strict=True):
            if len(post) > DENSE * n:
                row = np.zeros(n, self.kind)
                row[post] = 1
                self.rows[k] = row
            else:
                self.posts[k] = np.sort(post)
        self.needs: dict[tuple[int, float], tuple[int, int, np.ndarray]] = {}

    def _need(self, m: int, gate: float) -> tuple[int, int, np.ndarray]:
        """Which strings aren't too short or long, and how many characters they must have in common with a form of length m."""
        if (m, gate) not in self.needs:
            need = np.ceil(gate * np.maximum(self.lens, m) - 1e-6)
            fit = np.flatnonzero(need <= np.minimum(self.lens, m))
            lo, hi = (int(fit[0]), int(fit[-1]) + 1) if len(fit) else (0, 0)
            self.needs[m, gate] = lo, hi, need[lo:hi].astype(np.int32 if self.kind is np.int32 or m > 255 else np.uint8)
        return self.needs[m, gate]

    def sharing(self, form: str, gate: float) -> np.ndarray:
        """The strings with enough characters in common, the FIRST likeliest in front."""
        lo, hi, need = self._need(len(form), gate)
        if lo == hi:
            return np.zeros(0, np.int64)
        common, seen = np.zeros(hi - lo, self.kind), {}
        for x in form:
            k = seen[x] = seen.get(x, -1) + 1
            key = ord(x) << 32 | k
            if (row := self.rows.get(key)) is not None:
                common += row[lo:hi]
            elif (post := self.posts.get(key)) is not None:
                a, b = np.searchsorted(post, (lo, hi))
                common[post[a:b] - lo] += 1
        got = np.flatnonzero(common >= need)
        if len(got) > FIRST:
            likely = np.argpartition(-(common[got] / np.maximum(self.lens[got + lo], len(form))), FIRST)
            got = got[likely]
        return got + lo

    def near(self, form: str, at: np.ndarray, gate: float) -> np.ndarray:
        """Those of some strings that a form of up to 64 characters is near to by the plain distance."""
        masks = np.zeros(len(self.place) + 1, np.uint64)
        for i, x in enumerate(form):
            masks[self.place.get(x, -1)] |= np.uint64(1 << i)
        at = np.sort(at)
        lens, start = self.lens[at], self.start[at]
        d = _distances(np.full(len(at), len(form)), lens, lambda j, lo: masks[self.text[start[lo:] + j]])
        return at[1.0 - d / np.maximum(lens, len(form)) >= gate]


def any_near(asked: list[str], others: list[str], gate: np.ndarray, cost: Cost, fold: Callable[[str], str]) -> np.ndarray:
    """Whether each asked string is similar to one of the others by its gate.

    ``fold`` gives forms whose plain distance is never above the weighted one.
    """
    found = np.zeros(len(asked), bool)
    forms = [fold(t) for t in asked]
    for begin in range(0, len(others), BLOCK):
        block = others[begin : begin + BLOCK]
        index = Index([fold(t) for t in block])
        block = [block[i] for i in index.order]
        left = [i for i in np.flatnonzero(~found).tolist() if forms[i]]
        for b in range(0, len(left), 512):
            some = left[b : b + 512]
            got = [index.sharing(forms[i], gate[i]) for i in some]
            i = np.repeat(some, [min(FIRST, len(g)) for g in got])
            if not len(i):
                continue
            j = np.concatenate([g[:FIRST] for g in got])
            found[i[_near([asked[x] for x in i], [block[x] for x in j], gate[i], cost)]] = True
            for x, g in zip(some, got, strict=True):
                at, size = FIRST, 256
                while not found[x] and at < len(g):
                    rest = g[at : at + size]
                    at, size = at + size, size * 4
                    if len(forms[x]) <= 64:
                        rest = index.near(forms[x], rest, gate[x])
                    for part in range(0, len(rest), 4096):
                        few = rest[part : part + 4096]
                        if _near([asked[x]] * len(few), [block[y] for y in few], np.full(len(few), gate[x]), cost).any():
                            found[x] = True
                            break
    return found


def near_in_groups(terms: list[str], groups: list[tuple[np.ndarray, np.ndarray]], least: float, least_short: float, cost: Cost, fold: Callable[[str], str]) -> np.ndarray:
    """Whether each term is similar to one of the others of its group; groups: the places of those asked about, and of the others."""
    found = np.zeros(len(terms), bool)
    gate = gates(terms, least, least_short)
    forms = [fold(t) for t in terms]
    plain = np.array([f == t for f, t in zip(forms, terms, strict=True)], bool)
    points, owner, lens = _points(forms)
    start = np.cumsum(lens) - lens
    # how often 128 kinds of characters are there, up to twice: what one lacks of the other's is at most the distance
    kind = np.bincount(owner * 128 + points % 128, minlength=len(terms) * 128).reshape(-1, 128)
    bits = np.concatenate([np.packbits(kind >= k, axis=1).view(np.uint64) for k in (1, 2)], axis=1)
    # the characters of a group are numbered, and each term asked about has a row of where it has them
    group, asks = np.full(len(terms), -1, np.int64), np.zeros(len(terms), bool)
    for g, (a, b) in enumerate(groups):
        group[a], group[b], asks[a] = g, g, True
    asks &= lens <= 64
    keys, number = np.unique((group[owner] + 1) << 32 | points, return_inverse=True)
    first = np.searchsorted(keys, np.arange(len(groups) + 2) << 32)
    number -= first[group[owner] + 1]
    width = np.where(asks, np.diff(first)[group + 1], 0)
    row = np.cumsum(width) - width
    where = np.zeros(int(width.sum()), np.uint64)
    mine = asks[owner]
    np.bitwise_or.at(where, row[owner[mine]] + number[mine], np.left_shift(np.uint64(1), (np.arange(len(owner)) - start[owner])[mine].astype(np.uint64)))

    def decide(i: np.ndarray, j: np.ndarray) -> None:
        n = np.maximum(lens[i], lens[j])
        x, y = bits[i], bits[j]
        lacking = np.maximum(*(np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((x, y), (y, x))))
        lacking = np.maximum(lacking, np.abs(lens[i] - lens[j]))
        maybe = np.flatnonzero((1.0 - lacking / np.maximum(n, 1) >= gate[i]) & (n > 0))
        maybe = maybe[np.argsort(lens[j[maybe]], kind="stable")]
        near = [maybe[~asks[i[maybe]]]]
        maybe = maybe[asks[i[maybe]] & (lens[i[maybe]] > 0)]
        for b in range(0, len(maybe), 1 << 14):
            some = maybe[b : b + (1 << 14)]
            rows, texts = row[i[some]], start[j[some]]
            d = _distances(lens[i[some]], lens[j[some]], lambda k, lo, rows=rows, texts=texts: where[rows[lo:] + number[texts[lo:] + k]])
            near.append(some[1.0 - d / n[some] >= gate[i[some]]])
        some = np.concatenate(near)
        found[i[some[plain[i[some]] & plain[j[some]] & asks[i[some]]]]] = True
        some = some[~found[i[some]]]
        if len(some):
            found[i[some][_near([terms[k] for k in i[some]], [terms[k] for k in j[some]], gate[i[some]], cost)]] = True

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for a, b in groups:
        held.append((np.repeat(a, len(b)), np.tile(b, len(a))))
        size += len(a) * len(b)
        if size >= PAIRS:
            decide(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        decide(*map(np.concatenate, zip(*held, strict=True)))
    return found
