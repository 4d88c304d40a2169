"""Matching entities of two tables that share no key, with a confidence for each match.

1. Names are put in plain characters. Rows that carry a name in several scripts teach, by counts over all
   rows, what the parts of a name are called in each: the beginning and end that names with the same first,
   second and last word share, and what is left between (origin, treatment, raw material, form).
2. Every distinct name is read as four parts, exactly or with slips; words cut short or badly misspelt have several
   readings. The names of a row vote. Rows whose votes agree on one reading form one node of their table; a row whose
   votes don't is a node of its own with all its readings and their shares.
3. Candidate pairs of nodes share a reading. Their prior log odds come from the share of votes both give to common readings,
   against the rate of misreadings and the chance that a wrong reading stands in the other table, and from what codes and
   other fields say: the log ratio of how often they agree (or go together) among sure pairs and among any two rows.
4. Loopy belief propagation with one-to-one factors: the message of a pair to one end is its odds divided
   by one plus the messages from the other pairs of the other end, exchanged through grouped sums and joins
   until nothing moves. So a row that can be read in two ways goes to the partner that no surer row takes. The marginal
   probability is the confidence. Pairs whose ends have no other pair need no messages.

Defined results: rows without a name that can be read as four parts match nothing; null codes and fields are no
evidence; empty tables give no match; repeated rows each match; columns with clashing names don't matter,
as only key, names, code and the named fields are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, spread
from .reference_map import osa
from .unify import unify_column

#: A word is a part's name if it was seen this often, in this share of cases, and is no rarer than this share of the
#: common ones.
SEEN, SHARE, RARE = 3, 0.6, 0.05
#: A reading with so many times the votes of the next stands alone.
CLEAR = 1.5
#: The misreading rate is taken to be this at least; more values of a field, or surfaces in the vocabulary, than these are refused.
LEAST_ERROR, VALUES, VOCABULARY = 0.01, 10_000, 500_000
#: Pairs as expected that are added to those seen of two values.
PRIOR = 20
#: Words or characters a part's name has at most.
LONGEST = 64
PARTS = ("o", "t", "b", "f")
# Katakana by rows of consonants, vowels in the order a, i, u, e, o.
_ROWS = {"": "アイウエオ", "k": "カキクケコ", "g": "ガギグゲゴ", "s": "サシスセソ", "z": "ザジズゼゾ", "t": "タチツテト", "d": "ダヂヅデド", "n": "ナニヌネノ", "h": "ハヒフヘホ", "b": "バビブベボ", "p": "パピプペポ", "m": "マミムメモ", "r": "ラリルレロ"}
_LATIN = {k: c + v for c, row in _ROWS.items() for k, v in zip(row, "aiueo", strict=True)} | {"ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa"}
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_JUNK = re.compile(r"[\W_]+")


def forms_of(name: str) -> tuple[str, ...]:
    """A plain name as words, with a part turned round by a comma put in front; Japanese as characters."""
    if _CJK.search(name):
        return tuple(_JUNK.sub("", name))
    name = name.lower().strip(" ,;.。、:")
    if name.count(",") == 1:
        a, b = name.split(",")
        name = f"{b} {a}"
    return tuple(_WORDS.findall(name.replace("β-", "β")))


def _plain_lists(col: pa.Array) -> list[list[tuple[str, ...]]]:
    """The forms of the names of each row."""
    flat, _ = unify_column(col.flatten())
    names = [forms_of(n) if n else () for n in flat.to_pylist()]
    out, at = [], 0
    for n in (0 if x is None else x for x in [None if not v.is_valid else len(v) for v in col]):
        out.append(names[at : at + n])
        at += n
    return out


def _pairs(names: DataFrame) -> DataFrame:
    """Distinct pairs of a four-word name and another name of the same row, words joined by \\x02.

    Distinct, so that copies of one row, however many, teach once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {
                ("\x02".join(p), "\x02".join(y))
                for names in _plain_lists(batch.column(0))
                for p in names
                if len(p) == 4 and not _CJK.search(p[0])
                for y in names
                if y != p and len(y) >= 4 and (_CJK.search(y[0]) or y[0] == p[0])
            }
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["p", "y"])

    return checkpointed(spread(names).mapInArrow(run, "p string, y string").distinct())


def _tally(pairs: DataFrame, see) -> dict[tuple[str, str, str], tuple[str, int]]:
    """Run ``see(count, p, y, script)`` over all pairs and return the surfaces that prevail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def emit() -> pa.RecordBatch:
            cols = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [[]] * 5
            seen.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.int64())], names=["script", "part", "word", "surface", "n"])

        for batch in batches:
            for p, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                see(seen, p.split("\x02"), y.split("\x02"), "c" if _CJK.search(y[0]) else "w")
            if len(seen) > 500_000:  # counts are summed later, so memory stays bounded
                yield emit()
        yield emit()

    return _top(pairs.mapInArrow(run, "script string, part string, word string, surface string, n bigint"))


def _grow(seen: Counter, script: str, part: str, word: str, body: list[str], back: bool = False) -> None:
    """Count every beginning (or ending) of a name, and the case itself."""
    seen["n" + script, part, word, ""] += 1
    for i in range(1, min(LONGEST, len(body) - 1) + 1):
        seen[script, part, word, "\x02".join(body[-i:] if back else body[:i])] += 1


def learn(names: DataFrame) -> dict[str, dict[str, str]]:
    """For each part and script (w: words, c: characters), surfaces and the class they name.

    ``names``: one array<string> column. What is collected is the vocabulary of parts.
    """
    pairs = _pairs(names)

    def outer(seen: Counter, p: list[str], y: list[str], s: str) -> None:
        seen["p", "o", p[0], ""] += 1
        _grow(seen, s, "f", p[3], y if s == "c" else y[1:], back=True)
        if s == "c":
            _grow(seen, s, "o", p[0], y)
        else:
            _grow(seen, s, "t", p[1], y[1:])

    known = _tally(pairs, outer)
    origins = {w: int(s) for (k, _, w), s in known.items() if k == "p"}

    def split(known: dict, p: list[str], y: list[str], s: str, parts: str) -> list[str] | None:
        """What is left of y without its origin, treatment (if in ``parts``) and form."""
        for part, word in zip(parts, p, strict=False):
            front = [p[0]] if (s, part) == ("w", "o") else known.get((s, part, word), "\x00").split("\x02")
            if y[: len(front)] != front:
                return None
            y = y[len(front) :]
        return y

    def second(seen: Counter, p: list[str], y: list[str], s: str) -> None:
        if s == "c" and (rest := split(known, p, y, s, "o")):
            _grow(seen, s, "t", p[1], rest)

    known = {**known, **_tally(pairs, second)}

    def third(seen: Counter, p: list[str], y: list[str], s: str) -> None:
        back = known.get((s, "f", p[3]), "\x00").split("\x02")
        rest = split(known, p, y, s, "ot")
        if rest and len(rest) > len(back) and rest[-len(back) :] == back:
            seen["n" + s, "b", p[2], ""] += 1
            seen[s, "b", p[2], "\x02".join(rest[: -len(back)])] += 1

    return _classes({**known, **_tally(pairs, third)}, origins)


def _top(counts: DataFrame) -> dict[tuple[str, str, str], str]:
    """The longest surface that SHARE of a word's cases have; for pivots (script p) how often they were seen.

    Words far rarer than the usual ones of their part are slips and abbreviations, not names. What is collected has
    the size of the vocabulary.
    """
    total = counts.groupBy("script", "part", "word", "surface").agg(F.sum("n").alias("n")).filter(F.col("n") >= SEEN)
    kinds = F.substring("script", 1, 1)
    words = total.filter(kinds.isin("n", "p")).select("script", "part", "word", F.col("n").alias("cases"))
    usual = words.groupBy("script", "part").agg(F.percentile_approx("cases", 0.9, 1000).alias("p90"))
    words = words.join(usual, ["script", "part"]).filter(F.col("cases") >= RARE * F.col("p90")).drop("p90")
    surfaces = total.filter(kinds.isin("c", "w")).withColumn("_s", F.concat(F.lit("n"), "script"))
    kept = surfaces.join(words.withColumnRenamed("script", "_s"), ["_s", "part", "word"]).filter(F.col("n") >= SHARE * F.col("cases"))
    out: dict[tuple[str, str, str], str] = {}
    best: dict[tuple[str, str, str], tuple[int, int]] = {}
    rows = kept.select("script", "part", "word", "surface", "n").limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} names of parts")
    for r in rows:
        k = (r.script, r.part, r.word)
        size = (r.surface.count("\x02"), r.n)
        if k not in best or size > best[k]:
            best[k] = size
            out[k] = r.surface
    for r in words.filter("script = 'p'").collect():
        out["p", r.part, r.word] = str(r.cases)
    return out


def _classes(known: dict[tuple[str, str, str], str], origins: dict[str, int]) -> dict[str, dict[str, str]]:
    """Surface to class for each part and script; words that translate into each other share a class."""
    up: dict[tuple[str, str, str], tuple[str, str, str]] = {}

    def root(x: tuple) -> tuple:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for o in origins:
        root(("o", "w", o))
    for (s, part, word), surface in known.items():
        if s in "cw":
            clean = surface.replace("\x02", "" if s == "c" else " ")
            up[root((part, "w", word))] = root((part, s, clean))
    out: dict[str, dict[str, str]] = {p + s: {} for p in PARTS for s in "wc"}
    members: dict[tuple, list] = {}
    for x in list(up):
        members.setdefault(root(x), []).append(x)
    common = sorted(origins, key=lambda o: (-origins[o], o))
    for group in members.values():
        # a rare origin one slip from a common one is that one, misspelt
        if len(group) == 1 and group[0][0] == "o" and any(origins[o] >= 8 * origins[group[0][2]] and osa(o, group[0][2], 1) == 1 for o in common):
            continue
        # a class needs the words of two scripts or languages, or is an origin
        if len(group) < 2 and group[0][0] != "o":
            continue
        name = min(g[2] for g in group)
        for part, s, surface in group:
            out[part + s][surface.replace(" ", "")] = name
    return out


class Reader:
    """Reads names as four parts by learnt vocabularies."""

    def __init__(self, vocab: dict[str, dict[str, str]]):
        self.vocab = vocab
        self.near = {k: self._deletes(v) for k, v in vocab.items()}
        self.sizes = {k: sorted({len(s) for s in v}) for k, v in vocab.items()}

    @staticmethod
    def _deletes(v: dict[str, str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for s in v:
            for x in {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}:
                out.setdefault(x, []).append(s)
        return out

    def part(self, key: str, s: str) -> list[tuple[int, str]]:
        """(slips, class) of surfaces equal to s or one slip away."""
        if (c := self.vocab[key].get(s)) is not None:
            return [(0, c)]
        # nothing longer than the longest surface and a slip can be one
        if not self.sizes[key] or len(s) < (3 if key[1] == "w" else 2) or len(s) > self.sizes[key][-1] + 1:
            return []
        found = {}
        for x in {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}:
            for y in self.near[key].get(x, ()):
                if min(len(y), len(s)) >= 2 and osa(s, y, 1) <= 1:
                    found[self.vocab[key][y]] = 1
        return [(d, c) for c, d in found.items()]

    def _begun(self, key: str, s: str) -> list[str]:
        """The class of s, or all with a surface that s begins."""
        if (c := self.vocab[key].get(s)) is not None:
            return [c]
        return sorted({c for y, c in self.vocab[key].items() if y.startswith(s)}) if len(s) >= 3 else []

    def read(self, form: tuple[str, ...]) -> list[tuple[int, tuple[str, str, str, str]]]:
        """(slips, parts) of the best readings of a name, several if they are equally good."""
        if not form:
            return []
        s = "c" if _CJK.search("".join(form)) else "w"
        if s == "w" and len(form) >= 4:
            # word by word, words cut short included
            cuts = [w for tw in (1, 2) if all(w := self._cut(form, tw))]
            for whole in cuts:
                if None not in (got := [self.vocab[p + s].get(w) for p, w in zip(PARTS, whole, strict=True)]):
                    return [(0, tuple(got))]
            for whole in cuts:
                if all(got := [self._begun(p + s, w) for p, w in zip(PARTS, whole, strict=True)]):
                    return [(1, x) for x in product(*got)]
        text = "".join(form)
        options: dict[tuple, int] = {}
        turned = [text]
        if s == "w":
            turned += [form[-1] + "".join(form[:-1])] if len(form) >= 2 else []
        for t in turned:
            self._scan(t, s, options)
            if options and min(options.values()) == 0:
                break
        if not options:
            return (self._lone(form) if s == "w" and len(form) >= 4 else []) or self._rare(form, text, s)
        least = min(options.values())
        return [(d, x) for x, d in sorted(options.items()) if d == least]

    @staticmethod
    def _cut(form: tuple[str, ...], tw: int) -> list[str]:
        """A name of words as four parts, ``tw`` words for the treatment."""
        return [form[0], "".join(form[1 : 1 + tw]), "".join(form[1 + tw : -1]), form[-1]]

    def _lone(self, form: tuple[str, ...]) -> list[tuple[int, tuple[str, str, str, str]]]:
        """A name of words all but one of which are exact; that one may have two or three slips."""
        found: dict[tuple, int] = {}
        for tw in (1, 2):
            whole = self._cut(form, tw)
            got = [self.vocab[p + "w"].get(w) for p, w in zip(PARTS, whole, strict=True)]
            if all(whole) and got.count(None) == 1:
                i = got.index(None)
                most = 3 if len(whole[i]) >= 10 else 2 if len(whole[i]) >= 6 else 1
                for y, c in self.vocab[PARTS[i] + "w"].items():
                    if (d := osa(whole[i], y, most)) <= most:
                        x = (*got[:i], c, *got[i + 1 :])
                        found[x] = min(d, found.get(x, 9))
        least = min(found.values(), default=0)
        return [(d, x) for x, d in sorted(found.items()) if d == least]

    def _rare(self, form: tuple[str, ...], text: str, s: str) -> list[tuple[int, tuple[str, str, str, str]]]:
        """A name whose origin was seen too seldom to be learnt; its other parts must be exact."""
        found = set()
        for i in (len(form[0]),) if s == "w" else (3, 4, 5):
            o = text[:i] if s == "w" else "".join(_LATIN.get(c, " ") for c in text[:i])
            rest = text[i:]
            for j in self.sizes["f" + s]:
                if " " not in o and (f := self.vocab["f" + s].get(rest[len(rest) - j :])) and j < len(rest):
                    for k in self.sizes["t" + s]:
                        t, b = self.vocab["t" + s].get(rest[:k]), self.vocab["b" + s].get(rest[k : len(rest) - j])
                        if t and b:
                            found.add((self.vocab["ow"].get(o, o), t, b, f))
        return [(1, x) for x in sorted(found)]

    def _scan(self, text: str, s: str, options: dict[tuple, int]) -> None:
        n = len(text)
        lens = {p: sorted({y for z in self.sizes[p + s] for y in (z - 1, z, z + 1) if y > 0}) for p in PARTS}
        heads = [(i, d, c) for i in lens["o"] if i < n for d, c in self.part("o" + s, text[:i])]
        tails = [(i, d, c) for i in lens["f"] if i < n for d, c in self.part("f" + s, text[n - i :])]
        for i, d1, o in heads:
            for j, d4, f in tails:
                mid = text[i : n - j]
                if len(mid) < 2 or d1 + d4 > 2:
                    continue
                for k in lens["t"]:
                    if k < len(mid):
                        for d2, t in self.part("t" + s, mid[:k]):
                            for d3, b in self.part("b" + s, mid[k:]) if d1 + d4 + d2 <= 2 else ():
                                total = d1 + d2 + d3 + d4
                                if total <= 3 and total < options.get((o, t, b, f), 9):
                                    options[o, t, b, f] = total


NODE = "row bigint, node bigint, readings array<struct<o:string,t:string,b:string,f:string,share:double>>, lead double, code string"


def nodes(df: DataFrame, key: str, vocab: dict[str, dict[str, str]], fields: tuple[str, ...] = ()) -> DataFrame:
    """(row, node, readings, lead, code, *fields) of the rows whose names can be read.

    A row with a clear reading has that one alone, with share 1; ``lead`` is the share of votes of its best reading.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocab)
    kind = pa.list_(pa.struct([*((p, pa.string()) for p in PARTS), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, memo = None, {}
        for batch in batches:
            reader = reader or Reader(shared.value)
            at, ids, readings, leads, codes = [], [], [], [], []
            for i, (code, names) in enumerate(zip(batch.column(2).to_pylist(), _plain_lists(batch.column(1)), strict=True)):
                votes: dict[tuple, float] = {}
                for form in sorted(set(names)):
                    if form not in memo:
                        if len(memo) > 50_000:
                            memo.clear()
                        memo[form] = reader.read(form)
                    for d, p in memo[form]:
                        votes[p] = votes.get(p, 0.0) + 1.0 / (1 + 2 * d) / len(memo[form])
                if not votes:
                    continue
                order = sorted(votes.items(), key=lambda x: (-x[1], x[0]))
                total = sum(votes.values())
                clear = len(order) == 1 or order[0][1] >= CLEAR * order[1][1]
                some = [(*order[0][0], 1.0)] if clear else [(*p, round(v / total, 3)) for p, v in order]
                at.append(i)
                ids.append(int.from_bytes(blake2b(repr(some).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
                readings.append([dict(zip((*PARTS, "share"), x, strict=True)) for x in some])
                leads.append(order[0][1] / total)
                codes.append(re.sub(r"[\W_]+", "", code).lower() or None if code else None)
            take = pa.array(at, pa.int64())
            cols = [batch.column(0).take(take), pa.array(ids, pa.int64()), pa.array(readings, kind), pa.array(leads, pa.float64()), pa.array(codes, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(3 + k).take(take) for k in range(len(fields)))], names=["row", "node", "readings", "lead", "code", *(f"f{k}" for k in range(len(fields)))])

    src = spread(df.select(F.col(key).cast("bigint"), "names", "e_number", *[F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)]).filter("names is not null"))
    return src.mapInArrow(run, NODE + "".join(f", f{k} string" for k in range(len(fields))))


def propagate(edges: DataFrame, rounds: int = 1000, tolerance: float = 1e-3, free: int = 8, damping: float = 0.5) -> DataFrame:
    """Marginal probability ``p`` of every candidate (l, r, w) with prior log odds w, one-to-one.

    Rounds go on until no message moves by ``tolerance``; after ``free`` of them messages are damped. That they settle is known
    for these factors; should they not in ``rounds``, this is an error and no result.
    """
    e = checkpointed(edges.select("l", "r", F.exp("w").alias("w")))
    degree = [e.groupBy(k).agg(F.count("*").alias(f"_{k}")) for k in ("l", "r")]
    e = checkpointed(e.join(degree[0], "l").join(degree[1], "r"))
    alone = e.filter("_l = 1 and _r = 1").select("l", "r", (F.col("w") / (1 + F.col("w"))).alias("p"))
    e = e.filter("_l > 1 or _r > 1").select("l", "r", "w", F.lit(1.0).alias("a"), F.lit(1.0).alias("z"))
    if e.isEmpty():
        return alone
    for n in range(rounds):
        left = e.groupBy("l").agg(F.sum(F.col("w") * F.col("z")).alias("sl"))
        right = e.groupBy("r").agg(F.sum(F.col("w") * F.col("a")).alias("sr"))
        old = damping if n >= free else 0.0
        rest_l = F.greatest(F.col("sl") - F.col("w") * F.col("z"), F.lit(0.0))
        rest_r = F.greatest(F.col("sr") - F.col("w") * F.col("a"), F.lit(0.0))
        a, z = ((1 - old) / (1 + rest) + old * F.col(c) for rest, c in ((rest_l, "a"), (rest_r, "z")))
        new = e.join(left, "l").join(right, "r").select("l", "r", "w", a.alias("a"), z.alias("z"), F.col("a").alias("a0"), F.col("z").alias("z0"))
        new = checkpointed(new.withColumn("moved", F.greatest(F.abs(F.col("a") - F.col("a0")), F.abs(F.col("z") - F.col("z0")))))
        moved = new.agg(F.max("moved")).first()[0]
        e = new.select("l", "r", "w", "a", "z")
        if moved < tolerance:
            odds = F.col("w") * F.col("a") * F.col("z")
            return alone.unionByName(e.select("l", "r", (odds / (1 + odds)).alias("p")))
    raise RuntimeError(f"messages still move after {rounds} rounds")


def _groups(rows: DataFrame, side: str, fields: int) -> DataFrame:
    """One row per node: how many rows it has, its readings, codes, and the least value of each field."""
    agg = [F.count("*").alias(f"{side}_n"), F.first("readings").alias(f"{side}_readings"), F.array_sort(F.collect_set("code")).alias(f"{side}_codes")]
    return rows.groupBy(F.col("node").alias(side)).agg(*agg, *[F.min(f"f{k}").alias(f"{side}_f{k}") for k in range(fields)])


def _field_odds(sure: DataFrame, sides: list[DataFrame], k: int) -> DataFrame:
    """(l_fk, r_fk, odds_k): the log ratio of how often two values go together among sure pairs and among any, with some expected pairs added."""
    n = f"f{k}"

    def few(x: DataFrame) -> list:
        got = x.limit(VALUES + 1).collect()
        if len(got) > VALUES:
            raise ValueError(f"a field of more than {VALUES} values is no evidence")
        return got

    rows = few(sure.filter(F.col(f"l_{n}").isNotNull() & F.col(f"r_{n}").isNotNull()).groupBy(f"l_{n}", f"r_{n}").agg(F.count("*").alias("c")))
    single = [dict(map(tuple, few(x.filter(F.col(f"{s}_{n}").isNotNull()).groupBy(f"{s}_{n}").count()))) for x, s in zip(sides, ("l", "r"), strict=True)]
    seen = {(r[0], r[1]): r.c for r in rows}
    total, per = sum(r.c for r in rows), [max(1, sum(x.values())) for x in single]
    out = []
    for a, na in single[0].items():
        for b, nb in single[1].items():
            expected = na / per[0] * nb / per[1]
            out.append((a, b, math.log((seen.get((a, b), 0) + PRIOR * expected) / ((total + PRIOR) * expected))))
    return sure.sparkSession.createDataFrame(out, f"l_{n} string, r_{n} string, odds_{k} double")


def matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, fields: tuple[tuple[str, str], ...] = (), least: float = 0.5) -> DataFrame:
    """(left_key, right_key, confidence) of every pair of rows that describe the same thing.

    ``fields``: pairs of columns, one of each table, of few values, whose combinations may tell.
    """
    vocab = learn(left.select("names").unionAll(right.select("names")).filter("names is not null"))
    rows = [checkpointed(nodes(t, k, vocab, tuple(f[i] for f in fields))) for i, (t, k) in enumerate(((left, left_key), (right, right_key)))]
    groups = [checkpointed(_groups(r, s, len(fields))) for r, s in zip(rows, ("l", "r"), strict=True)]
    readings = [g.select(s, F.explode(f"{s}_readings").alias("x")).select(s, *[F.col(f"x.{p}").alias(p) for p in PARTS], F.col("x.share").alias(f"{s}_share")) for g, s in zip(groups, ("l", "r"), strict=True)]
    shared = readings[0].join(readings[1], list(PARTS)).groupBy("l", "r").agg(F.sum(F.col("l_share") * F.col("r_share")).alias("same"))
    # the share of each node's readings that the other table has
    for s, mine, other in (("l", *readings), ("r", *reversed(readings))):
        shared = shared.join(mine.join(other.select(*PARTS).distinct(), list(PARTS), "left_semi").groupBy(s).agg(F.sum(f"{s}_share").alias(f"{s}_covered")), s)
    pairs = checkpointed(shared.join(groups[0].drop("l_readings"), "l").join(groups[1].drop("r_readings"), "r"))
    return _rows(checkpointed(_decided(pairs, rows, groups, readings[1], len(fields), least)), *(r.select(F.col("node").alias(s), F.col("row").alias(k)) for r, s, k in zip(rows, ("l", "r"), (left_key, right_key), strict=True)), left_key, right_key, [r.count() for r in rows])


def _decided(pairs: DataFrame, rows: list[DataFrame], groups: list[DataFrame], right: DataFrame, fields: int, least: float) -> DataFrame:
    """Candidate pairs with the marginal probability of each, those below ``least`` left out."""
    error = max(LEAST_ERROR, *(float(r.agg(F.avg(1 - F.col("lead"))).first()[0] or 0.0) for r in rows))
    size = right.agg(F.count_distinct("r").alias("n"), *[F.count_distinct(p).alias(p) for p in PARTS]).first()
    chance = min(1.0, size.n / max(1, size.o * size.t * size.b * size.f))
    same = F.least(F.col("same"), F.lit(1.0 - error))
    # against no partner at all: a misreading, or a right reading that the other table lacks while a wrong one is there by chance
    lacking = F.greatest(1 - F.least("l_covered", "r_covered"), F.lit(0.0))
    w = F.log(same / (lacking * chance + error))
    sure = pairs.filter("same > 0.99")
    # codes: equal among sure pairs, equal among any two rows
    any_ = [r.filter("code is not null").groupBy("code").agg(F.count("*").alias(f"n{i}")) for i, r in enumerate(rows)]
    coded = [max(1, r.filter("code is not null").count()) for r in rows]
    by_chance = float(any_[0].join(any_[1], "code").agg(F.sum(F.col("n0") / coded[0] * F.col("n1") / coded[1])).first()[0] or 0.0)
    meet = F.arrays_overlap("l_codes", "r_codes")
    told = F.expr("size(l_codes) > 0 and size(r_codes) > 0")
    seen = sure.agg(F.count_if(told).alias("n"), F.count_if(told & meet).alias("eq")).first()
    u, m = min(0.99, max(by_chance, 1e-6)), (seen.eq + 0.5) / (seen.n + 1)
    w = w + F.when(~told, 0.0).when(meet, math.log(m / u)).otherwise(math.log((1 - m) / (1 - u)))
    judged = pairs
    for k in range(fields):
        odds = _field_odds(sure, groups, k)
        judged = judged.join(F.broadcast(odds), [f"l_f{k}", f"r_f{k}"], "left")
        w = w + F.coalesce(F.col(f"odds_{k}"), F.lit(0.0))
    p = propagate(judged.select("l", "r", w.alias("w"))).filter(F.col("p") >= least)
    return p.join(groups[0].select("l", "l_n"), "l").join(groups[1].select("r", "r_n"), "r")


def _rows(sure: DataFrame, lrow: DataFrame, rrow: DataFrame, left_key: str, right_key: str, totals: list[int], salts: int = 16) -> DataFrame:
    """All pairs of rows of the matched nodes.

    Nodes with more than a thousandth of their table's rows are few: their pairs are broadcast to the left rows, and the
    right rows are met in salted parts. The others are joined by hash, where no key is hot.
    """
    out = [left_key, right_key, F.col("p").alias("confidence")]
    hot = (F.col("l_n") > max(1, totals[0] // 1000)) | (F.col("r_n") > max(1, totals[1] // 1000))
    cool = sure.filter(~hot).join(lrow, "l").join(rrow, "r").select(*out)
    pairs = sure.filter(hot).select("l", "r", "p")
    salt = F.pmod(F.xxhash64(left_key), F.lit(salts)).cast("int").alias("salt")
    left = lrow.join(F.broadcast(pairs), "l").select(left_key, "r", "p", salt)
    right = rrow.join(F.broadcast(pairs.select("r").distinct()), "r", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return cool.unionAll(left.join(right, ["r", "salt"]).select(*out))
