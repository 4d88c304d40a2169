"""The line model: running headers and page numbers told from text by place, repetition and shape.

All lines of a batch of texts are one code-point array. From it come, by sums over lines, the features of each line: how
often its letters, or the first or last of them, occur again in the text; its length against the usual line; how it and its
neighbours begin and end; its place; whether it reads as a page number, and as the next one after another; and how much of it
are words that are known as furniture. Which words are is learnt from the scans themselves (``furniture_words``): those
mostly seen in short lines that a text repeats. An averaged perceptron over pairs of features decides.

No feature names a title, a maker or a language's words; pages made up for training have furniture of words drawn from the
clean sample.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, spread

TEXT, HEADER, PAGENO = 0, 1, 2
#: A word is furniture if this many texts, or this share of them, have it in repeated lines, and no more than so many times
#: as many in running lines.
TEXTS, SHARE, ELSEWHERE = 3, 1 / 20_000, 3.0
BITS = 16
#: The first and last letters of a line that are compared on their own; in Japanese.
EDGE, EDGE_CJK = 10, 4
# Words and signs beside page numbers.
_PAGE = re.compile(r"[\W_]*(?:(?:p|pp|pg|page|no|n|第)[\W_]*)?(\d+|(?-i:[ivxlc]+|[IVXLC]+)|[一二三四五六七八九十百]+)(?:[\W_]*(?:of|/|von)?[\W_]*\d+)?[\W_]*(?:頁|ページ|页)?[\W_]*", re.IGNORECASE)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_KANJI = {c: i for i, c in enumerate("一二三四五六七八九", 1)}
OTHER, LOWER, UPPER, KANA, KANJI, HIRA, DIGIT, SPACE, STOP, COMMA = range(10)


@cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """The class and the lower-case form of every code point."""
    kind, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x30000):
        x = chr(c)
        if x.isalpha():
            kind[c] = UPPER if x.isupper() else LOWER
            if len(y := x.lower()) == 1:
                low[c] = ord(y)
        elif x.isdigit():
            kind[c] = DIGIT
        elif x.isspace():
            kind[c] = SPACE
    kind[0x3041:0x3097], kind[0x30A1:0x30FF], kind[0x3400:0xA000], kind[0x3005] = HIRA, KANA, KANJI, KANJI
    for c in ".。!?！？．…":
        kind[ord(c)] = STOP
    for c in ",、;；，:：":
        kind[ord(c)] = COMMA
    return kind, low


def _number(s: str) -> tuple[int, int]:
    """The kind (1 digits, 2 roman, 3 kanji; 0 none) and the value of a line that is only a page number."""
    m = _PAGE.fullmatch(s)
    if not m:
        return 0, 0
    n = m.group(1).lower()
    if n.isdecimal():
        return 1, int(n[-9:])
    if n[0] in _ROMAN:
        v = [_ROMAN[c] for c in n]
        return 2, sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True))
    total = one = 0
    for c in n:
        if c in _KANJI:
            one = _KANJI[c]
        else:
            total += max(one, 1) * (10 if c == "十" else 100)
            one = 0
    return 3, total + one


@dataclass
class Lines:
    """What is known of each line of a batch of texts."""

    text: np.ndarray  # its text
    place: np.ndarray  # its number in the text
    count: np.ndarray  # lines of the text
    bins: list[np.ndarray]  # the features
    blank: np.ndarray
    page: np.ndarray  # the kind of page number, 0 if it isn't one
    repeated: np.ndarray  # lines of the text with the same letters
    full: np.ndarray  # a running line: long, or ended by a stop
    words: np.ndarray  # hashes of words and of pairs of words
    word_line: np.ndarray  # the line of each word


def _sum(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, at)


def _known(furniture: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes are among those of furniture."""
    return furniture[np.minimum(np.searchsorted(furniture, h), len(furniture) - 1)] == h if len(furniture) else np.zeros(len(h), bool)


def _again(text: np.ndarray, h: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """How many lines of a text have the same hash."""
    key = h ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    return np.where(ok, n[back], 0)


def lines_of(texts: list[str], furniture: np.ndarray) -> Lines:
    """The lines of texts (``split('\\n')`` of each) and their features; ``furniture``: sorted hashes of known words."""
    kind_of, lower = classes()
    stream = "\n".join(texts) + "\n"
    cp = np.frombuffer(stream.encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(cp == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = np.array([t.count("\n") + 1 for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(starts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    count = np.repeat(sizes, sizes)
    n = len(starts)
    line = np.repeat(np.arange(n), ends + 1 - starts)
    kind = kind_of[cp]
    solid = kind != SPACE
    at = np.arange(len(cp))
    first = np.minimum.reduceat(np.where(solid, at, len(cp)), starts)
    last = np.maximum.reduceat(np.where(solid, at, -1), starts)
    blank = last < 0
    first, last = np.where(blank, starts, first), np.where(blank, starts, last)
    width = np.where(blank, 0, last - first + 1)
    # the usual width of a text's lines
    order = np.lexsort((width, blank, text))
    filled = np.bincount(text[~blank], minlength=len(texts))
    mid = np.cumsum(sizes) - sizes + filled // 2
    usual = np.maximum(1, width[order][np.minimum(mid, n - 1)])[text]
    # letters, as a polynomial hash of the whole and of the first and last few, which outlast a misreading elsewhere
    letter = (kind >= LOWER) & (kind <= HIRA)
    letters = _sum(letter.astype(np.int64), starts)
    rank = np.cumsum(letter) - letter
    rank -= np.repeat(rank[starts], ends + 1 - starts)
    power = np.cumprod(np.full(int(letters.max()) + 1 if n else 1, 0x100000001B3, np.uint64))
    x = (lower[cp].astype(np.uint64) + np.uint64(0x51)) * np.uint64(0xC2B2AE3D27D4EB4F)
    size = letters[line]
    cjk = _sum(((kind >= KANA) & (kind <= HIRA)).astype(np.int64), starts) * 2 > letters
    edge = np.where(cjk, EDGE_CJK, EDGE)

    def letters_hash(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
        return _sum(np.where(mask, x * power[np.where(mask, rank - off, 0)], np.uint64(0)), starts)

    zero = np.zeros(len(cp), np.int64)
    whole = letters_hash(letter, zero)
    front = letters_hash(letter & (rank < edge[line]), zero)
    back = letters_hash(letter & (rank >= size - edge[line]), np.maximum(size - edge[line], 0))
    enough = letters >= np.where(cjk, 4, 6)
    again = _again(text, whole, enough)
    edges = np.maximum(_again(text, front, enough), _again(text, back, enough))
    # page numbers, and whether they count up
    page, value = np.zeros(n, np.int64), np.zeros(n, np.int64)
    short = np.flatnonzero(~blank & (width <= 24) & (letters <= 12))
    for i in short.tolist():
        page[i], value[i] = _number(stream[first[i] : last[i] + 1])
    seq = np.zeros(n, bool)
    p = np.flatnonzero(page > 0)
    if len(p) > 1:
        up = (text[p[1:]] == text[p[:-1]]) & (value[p[1:]] == value[p[:-1]] + 1)
        seq[p[1:][up]] = seq[p[:-1][up]] = True
    numbers = np.bincount(text[p], minlength=len(texts))[text]
    # words: runs of one class, capitals and small letters together
    group = np.where(kind == UPPER, LOWER, kind)
    begins = letter & np.concatenate([[True], (group[1:] != group[:-1]) | ~letter[:-1]])
    word_at = np.flatnonzero(begins)
    word_no = np.cumsum(begins) - 1
    inside = np.flatnonzero(letter)
    pos = rank[inside] - rank[word_at][word_no[inside]] if len(word_at) else rank[:0]
    words = np.bincount(word_no[inside], minlength=len(word_at)).astype(np.int64) if len(word_at) else np.zeros(0, np.int64)
    h = np.zeros(len(word_at), np.uint64)
    if len(word_at):
        h = np.add.reduceat(x[inside] * power[pos], np.concatenate([[0], np.cumsum(words)[:-1]]))
    word_line = line[word_at]
    # each pair of words of a line counts as well: it shows furniture made of everyday words
    two = np.flatnonzero(word_line[1:] == word_line[:-1])
    pairs = h[two] * np.uint64(0x9E3779B97F4A7C15) + h[two + 1]
    known = _known(furniture, h)
    both = two[_known(furniture, pairs)]
    known[both] = known[both + 1] = True
    share = np.bincount(word_line, words * known, n) / np.maximum(1, letters)
    capital = np.bincount(word_line, kind[word_at] == UPPER, n) / np.maximum(1, np.bincount(word_line, minlength=n))
    digits = _sum((kind == DIGIT).astype(np.int64), starts)
    wide = np.zeros(len(cp), bool)
    wide[2:] = (kind[2:] == SPACE) & (kind[1:-1] == SPACE) & (kind[:-2] == SPACE) & (cp[2:] != 10) & (cp[1:-1] != 10) & (cp[:-2] != 10)
    gap = _sum((wide & (at < last[line]) & (at > first[line])).astype(np.int64), starts) > 0
    a, z = kind[first], kind[last]
    after, before = np.roll(np.arange(n), -1), np.roll(np.arange(n), 1)
    top, bottom = place == 0, place == count - 1
    ended = np.select([top, blank[before], page[before] > 0, z[before] == STOP, z[before] == COMMA], [0, 1, 2, 3, 4], 5)
    goes_on = np.select([bottom, blank[after], page[after] > 0, a[after] == LOWER, a[after] == UPPER], [0, 1, 2, 3, 4], 5)
    ratio = width / usual
    bins = [
        np.minimum(again, 3), np.minimum(edges, 3), page + 4 * seq, np.searchsorted([0.2, 0.4, 0.6, 0.75, 0.9, 1.02, 1.2], ratio), z, a, ended, goes_on,
        np.minimum(place, 2) * 3 + np.minimum(count - 1 - place, 2), np.searchsorted([0.01, 0.3, 0.55, 0.8], share), np.where(cjk, 5, np.searchsorted([0.01, 0.3, 0.6, 0.95], capital)),
        np.minimum(digits, 2) * 2 + gap, np.searchsorted([2, 6, 13, 30], count), np.minimum(numbers, 3),
    ]
    return Lines(text, place, count, bins, blank, page, again, (z == STOP) | (ratio >= 0.9), np.concatenate([h, pairs]), np.concatenate([word_line, word_line[two]]))


def hashed(bins: list[np.ndarray]) -> np.ndarray:
    """Every feature and every pair of features as a place in the weights."""
    b = [x.astype(np.uint64) for x in bins]
    cols = [v + np.uint64(64 * i) for i, v in enumerate(b)]
    out = np.empty((len(b[0]), len(cols) * (len(cols) + 1) // 2), np.int32)
    k = 0
    for i, u in enumerate(cols):
        for v in cols[i:]:
            h = (u * np.uint64(1024) + v) * np.uint64(0x9E3779B97F4A7C15)
            out[:, k] = h >> np.uint64(64 - BITS)
            k += 1
    return out


def score(weights: np.ndarray, bins: list[np.ndarray], block: int = 20_000) -> np.ndarray:
    """The class of each line, a block of lines at a time."""
    out = np.zeros(len(bins[0]), np.int64)
    for i in range(0, len(out), block):
        x = hashed([b[i : i + block] for b in bins])
        total = np.zeros((len(x), weights.shape[1]), np.float32)
        for c in range(x.shape[1]):
            total += weights[x[:, c]]
        out[i : i + block] = total.argmax(1)
    return out


def furniture_words(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that stand mostly in lines which a text repeats, by counts over all page texts.

    A kept word is in a certain share of the texts at least, so what is collected is bounded by the words of 20 000
    lines, however many texts there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            s = [t for t in batch.column(0).to_pylist() if t]
            if not s:
                continue
            x = lines_of(s, none)
            seed = (x.repeated >= 2) & ~x.full
            cols = []
            for of in (seed, x.full):
                w = np.flatnonzero(of[x.word_line])
                pair = np.unique(np.stack([x.words[w], x.text[x.word_line[w]].astype(np.uint64)]), axis=1)[0] if len(w) else none
                cols.append(np.unique(pair, return_counts=True))
            every = np.union1d(cols[0][0], cols[1][0])
            counts = [np.zeros(len(every), np.int64) for _ in cols]
            for c, (h, k) in zip(counts, cols, strict=True):
                c[np.searchsorted(every, h)] = k
            # the row of zero counts the texts
            yield pa.RecordBatch.from_arrays([pa.array(np.append(every.view(np.int64), 0)), pa.array(np.append(counts[0], len(s))), pa.array(np.append(counts[1], 0))], names=["h", "seed", "body"])

    src = spread(texts.select("text"))
    counts = checkpointed(src.mapInArrow(run, "h bigint, seed bigint, body bigint").groupBy("h").agg(F.sum("seed").alias("seed"), F.sum("body").alias("body")))
    total = counts.filter("h = 0").select(F.greatest(F.lit(TEXTS), F.ceil(F.col("seed") * SHARE)).alias("least"))
    kept = counts.filter("h <> 0").join(F.broadcast(total)).filter((F.col("seed") >= F.col("least")) & (F.col("body") <= ELSEWHERE * F.col("seed")))
    return np.sort(np.array([r.h for r in kept.select("h").collect()], np.int64).view(np.uint64))


# --- pages for training -------------------------------------------------------------------------------

# What may stand around a page number and in a title.
_AROUND = [("", ""), ("- ", " -"), ("~ ", " ~"), ("[", "]"), ("(", ")"), ("p. ", ""), ("Page ", ""), ("Page ", " of {m}"), ("", "."), ("第", "頁"), ("", " ページ"), ("— ", " —")]
_PARTS = ["", "", "", " Vol. {n}", " Part {r}", " No. {n}", " ({n})", " {y}", " v{n}", " - {n}", ": {n}"]
_PARTS_JA = ["", "", "", " 第{n}版", " 第{n}号", " {y}年", "（{n}）", " {n}巻"]


def roman(n: int) -> str:
    """A number up to 39 in roman numerals."""
    return "x" * (n // 10) + ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][n % 10]


def kanji(n: int) -> str:
    """A number up to 99 in kanji."""
    ones = ["", *_KANJI]
    return ((ones[n // 10] if n >= 20 else "") + "十" if n >= 10 else "") + ones[n % 10]


def _numbers(rng: random.Random) -> tuple[str, str, str]:
    """How one text prints its page numbers: before, after, and which numerals."""
    a, z = rng.choice(_AROUND)
    if rng.random() < 0.2:
        z = "/{m}" if rng.random() < 0.5 else z
    return a, z, rng.choice("dddddrk")


def _title(words: list[str], ja: bool, rng: random.Random) -> str:
    """A title of words of the language, in one of several casts, with or without a number."""
    some = [rng.choice(words) for _ in range(rng.randint(2, 5))]
    tail = rng.choice(_PARTS_JA if ja else _PARTS).format(n=rng.randint(1, 12), y=rng.randint(1990, 2030), r=roman(rng.randint(1, 12)).upper())
    if ja:
        return rng.choice(["", " ", "・"]).join(some[:3]) + tail
    cast = rng.random()
    some = [w.upper() if cast < 0.15 else w if cast > 0.9 else w.capitalize() if cast < 0.75 or i == 0 else w for i, w in enumerate(some)]
    return rng.choice([" ", " ", " ", " - ", " | ", ": "]).join([some[0], " ".join(some[1:])]) + tail


def made_page(lines: list[str], words: list[str], ja: bool, rng: random.Random, spoil) -> tuple[list[str], list[int], list[str]]:
    """A made-up text with furniture, what each line is, and the words of its titles if they may be known."""
    out: list[str] = []
    y: list[int] = []

    def put(s: str, k: int) -> None:
        out.append(s)
        y.append(k)

    title = _title(words, ja, rng)
    around = _numbers(rng)
    size, start, style = rng.randint(3, 12), rng.randint(1, 40), rng.random()
    once = len(lines) <= size or rng.random() < 0.2
    if once:
        size = max(1, len(lines))
    if rng.random() < 0.35:
        put(_title(words, ja, rng) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), TEXT)
    for k in range(0, len(lines), size):
        no = start + k // size
        n = around[0] + (roman(no % 39 + 1) if around[2] == "r" else kanji(no % 99 + 1) if around[2] == "k" else str(no)) + around[1].format(m=start + 30)
        h = title
        if rng.random() < 0.1:
            h = h.upper()
        if rng.random() < 0.1:
            h = h.replace(" ", "  ")
        if rng.random() < 0.35:
            h = spoil(spoil(h))
        if style < 0.3:
            put(h, HEADER)
        elif style < 0.5:
            put(f"{h}   {n}" if rng.random() < 0.5 else f"{n}   {h}", HEADER)
        elif style < 0.7:
            put(h, HEADER)
        for i, s in enumerate(lines[k : k + size]):
            if i and rng.random() < 0.03:
                put("", TEXT)
            put(s, TEXT)
            if rng.random() < 0.02:
                put(rng.choice([_title(words, ja, rng), f"{rng.randint(1, 900)} {rng.choice(words)}", rng.choice(words) + ":"]), TEXT)
        if 0.5 < style < 0.9:
            put(n, PAGENO)
    if rng.random() < 0.06:
        s = rng.choice(lines)
        again = s if s[-1:] in ".。" else s + "."
        out, y = out + [again] * 6, y + [TEXT] * 6
    known = [title] if once or rng.random() < 0.5 else []
    return out, y, known


def _paragraphs(some: list[str], rng: random.Random) -> list[list[str]]:
    """Sentences in up to three paragraphs; some begin as an earlier one did, as texts of set phrases do."""
    cut = sorted(rng.randint(1, len(some)) for _ in range(rng.randint(0, 2)))
    out = [p for p in (some[a:b] for a, b in zip([0, *cut], [*cut, len(some)], strict=True)) if p]
    for p in out[1:]:
        if rng.random() < 0.6:
            p.insert(0, re.sub(r"\d+", lambda _: str(rng.randint(2, 480)), rng.choice(out[0])))
    return out


def made_up(sentences: list[str], words: dict[bool, list[str]], is_ja, wrap, spoil, rng: random.Random, most: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of the lines of made-up pages."""
    texts, classes_, titles, k = [], [], [], 0
    while k < len(sentences) and len(texts) < most:
        ja = is_ja(sentences[k])
        some = [s for s in sentences[k : k + rng.randint(2, 12)] if is_ja(s) == ja]
        k += max(1, len(some))
        if not words[ja]:
            continue
        width = rng.randint(30, 64)
        lines = [spoil(x) for s in _paragraphs(some, rng) for x, _ in wrap("".join(s) if ja else " ".join(s), width, rng)]
        out, y, known = made_page(lines, words[ja], ja, rng, spoil)
        texts.append("\n".join(out))
        classes_ += y
        titles += known
    if not texts:
        return np.zeros((0, 1), np.int32), np.zeros(0, np.int64)
    # the words of the titles, but not all of them, are known; none that running text has as often, as in the counts of scans
    none, labels = np.zeros(0, np.uint64), np.array(classes_)
    x = lines_of(texts, none)
    h = np.unique(lines_of(titles, none).words) if titles else none
    body, n = np.unique(x.words[labels[x.word_line] == TEXT], return_counts=True)
    h = h[~_known(body[n > 2], h)]
    h = h[np.random.default_rng(3).random(len(h)) < 0.6]
    x = lines_of(texts, h)
    # a header that stands once and has no known word can't be told from a title: it teaches nothing
    again, edges, share = x.bins[0], x.bins[1], x.bins[9]
    keep = ~x.blank & ~((labels == HEADER) & (again < 2) & (edges < 2) & (share == 0))
    return hashed(x.bins)[keep], labels[keep]
