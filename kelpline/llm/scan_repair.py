"""Noise in text from scanned pages: furniture, divided words, misread characters.

Two averaged perceptrons are trained on a bounded sample of clean documents (``SAMPLE`` of them, those
with the smallest hashes), on which the marks of a scan are laid on purpose:

* a line model (``page_lines``) tells running headers and page numbers from text by place, repetition and shape, and by
  words that the scans themselves show to be furniture;
* a character editor predicts keep, replace, delete, insert and line-join for every character that can
  be a misreading or a division mark, from hashed character windows.

An exact check follows: an edit stands only if it turns a word (or, in Japanese, a character trigram) that the
documents don't have into one that they have; a line-join only if it makes such a word or neither half is one. What the
documents have is counted over all of them. Texts are handled in batches: one code-point array holds the lines of all texts of
a batch, so prediction is a few gathers and sums per window template.

Defined results: null and empty texts have no noise and stay as they are; CR before LF is no part of a
line; repeated texts give equal rows; texts of any length are handled whole. Without clean documents
nothing is found.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, spread
from . import page_lines

#: Documents the models are trained on at most, and characters used of all of them together.
SAMPLE, SAMPLE_CHARS = 6000, 6_000_000
#: Words and trigrams count if the documents have them twice, and once in so many.
RARE = 4_000_000
#: Marks that can divide a word at a line end.
MARKS = "-‐‑‒–¬=­"
# Characters and what a scanner may read instead of them.
MISREAD = [
    ("m", "rn"), ("w", "vv"), ("d", "cl"), ("h", "li"), ("n", "ri"), ("u", "ii"), ("e", "c"), ("a", "@"), ("i", "!"), ("l", "1"), ("s", "5"), ("g", "9"), ("b", "6"), ("t", "+"), ("o", "0"), ("z", "2"),
    ("い", "ﾚ丶"), ("は", "ﾚよ"), ("か", "カヽ"), ("に", "仁"), ("て", "τ"), ("ら", "5"), ("ロ", "囗"), ("書", "晝"), ("調", "諷"), ("読", "続"), ("使", "便"), ("量", "昌"), ("粉", "紛"), ("料", "科"), ("減", "滅"),
    ("多", "夛"), ("味", "昧"), ("糖", "搪"), ("冷", "泠"), ("商", "啇"), ("証", "詠"), ("存", "荐"), ("保", "俣"), ("開", "閧"), ("表", "袤"), ("温", "湿"), ("最", "晟"), ("原", "厚"), ("品", "晶"), ("油", "抽"),
]
#: A reading that lost a character, for the insert operation.
LOST = [("rn", "m"), ("cl", "d"), ("ri", "n"), ("li", "h")]
KEEP, DELETE, JOIN = 0, 1, 2
_BITS = 17
_PAD = 8
_SPLIT = re.compile(r"(?<=[。！？])|(?<=[.!?])\s+|\n+")
_LATIN = re.compile(r"[^\W\d_]", re.UNICODE)
_TOKEN = re.compile(r"[A-Za-zÀ-ɏ0-9@!+'’]+")
_KANA = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ々τ丶]")
_RUN = re.compile(r"[ァ-ヶー]{2,6}|[一-鿿]{2,6}")


def labels() -> tuple[list[str], dict[str, int]]:
    """Operations by number: keep, delete, join, then replacements and insertions."""
    names = ["keep", "delete", "join", *dict.fromkeys("=" + t for t, _ in MISREAD), *dict.fromkeys("+" + t for t, _ in LOST)]
    return names, {n: i for i, n in enumerate(names)}


_TEMPLATES = [(0,), (-1, 0), (0, 1), (-1, 0, 1), (-2, -1, 0), (0, 1, 2), (-2, -1, 0, 1), (-1, 0, 1, 2), (-2, -1, 0, 1, 2), (-4, -3, -2, -1, 0), (0, 1, 2, 3, 4), (-3, -2, -1, 0, 1, 2, 3)]


def windows(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashed window features of the positions ``at`` of a padded code-point array."""
    x = cp.astype(np.uint64)
    out = np.empty((len(at), len(_TEMPLATES)), np.int32)
    for k, template in enumerate(_TEMPLATES):
        h = np.full(len(at), (k + 1) * 0x9E3779B1, np.uint64)
        for o in template:
            h = (h ^ x[at + o]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(23)
        out[:, k] = (h >> np.uint64(7)) & np.uint64((1 << _BITS) - 1)
    return out


def train(x: np.ndarray, y: np.ndarray, classes: int, size: int, epochs: int = 3, seed: int = 5, batch: int = 256) -> np.ndarray:
    """Averaged perceptron over hashed features, updated a small batch at a time."""
    w, u = np.zeros((size, classes), np.float32), np.zeros((size, classes), np.float32)
    rng, step = np.random.default_rng(seed), 1
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            b = order[i : i + batch]
            xb, yb = x[b], y[b]
            p = w[xb].sum(1).argmax(1)
            bad = np.flatnonzero(p != yb)
            if len(bad):
                f = xb[bad].ravel()
                for cls, sign in ((yb, 1.0), (p, -1.0)):
                    c = np.repeat(cls[bad], xb.shape[1])
                    np.add.at(w, (f, c), np.float32(sign))
                    np.add.at(u, (f, c), np.float32(sign * step))
            step += 1
    return w - u / step


# --- noise for training -------------------------------------------------------------------------------


def _spoil(text: str, rng: random.Random, by_char: dict[str, list[str]], label: dict[str, int], rate: float) -> tuple[str, list[int]]:
    """A text with misreadings, and the operation that undoes each character."""
    out, ops = [], []
    i = 0
    while i < len(text):
        lost = next(((t, r) for t, r in LOST if text.startswith(t, i)), None)
        if lost and rng.random() < rate / 4:
            out.append(lost[1])
            ops.append(label["+" + lost[0]])
            i += len(lost[0])
            continue
        c = text[i]
        if c in by_char and rng.random() < rate:
            r = rng.choice(by_char[c])
            out.append(r)
            ops += [label["=" + c], *[DELETE] * (len(r) - 1)]
        else:
            out.append(c)
            ops.append(KEEP)
        i += 1
    return "".join(out), ops


def _wrap(text: str, width: int, rng: random.Random) -> list[tuple[str, bool]]:
    """Lines of a paragraph, and whether each ends in a divided word."""
    if _KANA.search(text):
        return [(text[i : i + width // 2], False) for i in range(0, len(text), width // 2)]
    lines, line = [], ""
    for word in text.split(" "):
        room = width - len(line) - 1
        if len(line) + 1 + len(word) <= width:
            line = f"{line} {word}" if line else word
        elif word.isalpha() and room > 3 and len(word) > room - 1 > 1 and rng.random() < 0.9:
            cut = min(room - 1, len(word) - 2)
            lines.append((f"{line} {word[:cut]}{rng.choice(MARKS)}", True))
            line = word[cut:]
        else:
            lines.append((line, False))
            line = word
    lines.append((line, False))
    return [x for x in lines if x[0]]


@dataclass
class Model:
    """Trained weights and what the exact check looks up."""

    lines: np.ndarray
    chars: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)
    trigrams: frozenset = field(default_factory=frozenset)
    letters: frozenset = field(default_factory=frozenset)
    furniture: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    looks: dict[str, tuple[str, ...]] = field(default_factory=dict)


def word_counts(texts: list[str]) -> Counter:
    """How often each word stands in some texts."""
    words: Counter = Counter()
    for t in texts:
        words.update(w.strip("'’!").lower() for w in _TOKEN.findall(t) if not any(c.isdigit() or c in "@+" for c in w))
    return words


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The character trigrams of the Japanese ones among some texts, three code points in one number, and their counts."""
    flat = "\0\0\0".join(re.sub(r"\d", "0", re.sub(r"\s+", "", t)) for t in texts if _KANA.search(t))
    x = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = (x[:-2] > 0) & (x[1:-1] > 0) & (x[2:] > 0)
    return np.unique(((x[:-2] << 42) | (x[1:-1] << 21) | x[2:])[inside], return_counts=True)


def look(word: str) -> str:
    """A word with every character put as its parts and look-alikes: all readings of one word have one look."""
    parts = _looks()
    return "".join([parts.get(c, c) for c in word])


@cache
def _looks() -> dict[str, str]:
    """What each character looks like: look-alikes share a sign, those read as two are put as two."""
    root: dict[str, str] = {}

    def up(c: str) -> str:
        while root.get(c, c) != c:
            c = root[c]
        return c

    both = [(t, r) for t, r in MISREAD + LOST if not _KANA.search(t + r)]
    for a, b in both:
        if len(a) == len(b) == 1:
            root[up(b)] = up(a)
    wide = {up(min(a, b, key=len)): max(a, b, key=len) for a, b in both if len(a) != len(b)}

    def parts(c: str) -> str:
        c = up(c)
        return "".join(map(parts, wide[c])) if c in wide else c

    return {c: parts(c) for a, b in both for c in a + b}


def fit(texts: list[str], seed: int = 11, words: dict[str, int] | None = None, trigrams: frozenset | None = None, furniture: np.ndarray | None = None) -> Model:
    """Train both models on clean texts.

    ``words`` and ``trigrams`` are what all documents have, ``furniture`` the words learnt from the scans; without them
    those of the texts serve, and none.
    """
    rng = random.Random(seed)
    names, label = labels()
    by_char: dict[str, list[str]] = {}
    for t, r in MISREAD:
        by_char.setdefault(t, []).append(r)
    sentences = [s.strip() for t in texts for s in _SPLIT.split(t) if s and len(s) > 12 and s.strip()[-1:] in ".。!?"]
    lexicon = dict(word_counts(texts)) if words is None else words
    grams = frozenset(trigram_counts(texts)[0].tolist()) if trigrams is None else trigrams
    # character editor
    gate = gates()
    xs, ys = [], []
    rng.shuffle(sentences)
    for k in range(0, len(sentences), 400):
        stream, ops = ["\n" * _PAD], [KEEP] * _PAD
        for s in sentences[k : k + 400]:
            for line, divided in _wrap(s, rng.randint(34, 60), rng):
                noisy, o = _spoil(line[:-1] if divided else line, rng, by_char, label, 0.04)
                if divided:
                    noisy, o = noisy + line[-1], [*o, JOIN]
                stream.append(noisy + "\n")
                ops += [*o, KEEP]
        stream.append("\n" * _PAD)
        ops += [KEEP] * _PAD
        cp = np.frombuffer("".join(stream).encode("utf-32-le"), np.uint32)
        op = np.array(ops, np.int32)
        at = np.flatnonzero(gate[np.minimum(cp, 0xFFFF)])
        at = at[(op[at] != KEEP) | (np.random.default_rng(seed + k).random(len(at)) < 0.5)]
        xs.append(windows(cp, at))
        ys.append(op[at])
        if sum(map(len, ys)) > 600_000:
            break
    chars = train(np.concatenate(xs), np.concatenate(ys), len(names), 1 << _BITS) if xs else np.zeros((1 << _BITS, len(names)), np.float32)
    # line model, on pages with titles of the rarer words
    some = sorted(word_counts(texts[:3000]).items())
    few = sorted(n for _, n in some)[len(some) * 3 // 4] if some else 0
    runs = sorted({w for t in texts[:1000] for w in _RUN.findall(t)})
    rare = {False: [w for w, n in some if n <= few and w.isalpha() and 2 < len(w) < 12], True: runs}
    lx, ly = page_lines.made_up(sentences, rare, lambda s: bool(_KANA.search(s)), _wrap, lambda s: _spoil(s, rng, by_char, label, 0.02)[0], rng)
    weights = train(lx, ly, 3, 1 << page_lines.BITS, epochs=10, batch=16) if len(lx) else np.zeros((1 << page_lines.BITS, 3), np.float32)
    looks: dict[str, list[str]] = {}
    for w in sorted(lexicon, key=lambda w: (-lexicon[w], w)):
        looks.setdefault(look(w), []).append(w)
    letters = frozenset(chr((g >> k) & 0x1FFFFF) for g in grams for k in (0, 21, 42))
    return Model(weights, chars.astype(np.float16), lexicon, grams, letters, furniture if furniture is not None else np.zeros(0, np.uint64), {k: tuple(v) for k, v in looks.items()})


def gates() -> np.ndarray:
    """The characters (below 2^16) that an operation other than keep can apply to."""
    g = np.zeros(0x10000, bool)
    for _, r in MISREAD + LOST:
        for c in r:
            g[ord(c)] = True
    for c in MARKS:
        g[ord(c)] = True
    return g


# --- applying -----------------------------------------------------------------------------------------


@dataclass
class Repaired:
    """The kinds of noise of each line, and the repaired text."""

    kinds: list[set[str]]
    text: str


def repair(texts: list[str], m: Model) -> list[Repaired]:
    """Repair a batch of texts."""
    names, _ = labels()
    gate = gates()
    split = [[x.removesuffix("\r") for x in t.split("\n")] for t in texts]
    kinds: list[list[set[str]]] = [[set() for _ in ls] for ls in split]
    # furniture
    x = page_lines.lines_of(["\n".join(ls) for ls in split], m.furniture) if texts else None
    if x is not None:
        y = page_lines.score(m.lines, x.bins)
        y[x.blank | ((y == page_lines.PAGENO) & (x.page == 0))] = page_lines.TEXT
        y[(y == page_lines.HEADER) & (x.page > 0)] = page_lines.PAGENO  # nothing but a page number
        for i in np.flatnonzero(y).tolist():
            kinds[x.text[i]][x.place[i]].add("header" if y[i] == page_lines.HEADER else "pageno")
    # one stream of the remaining lines of all texts
    parts, owner, size = ["\n" * _PAD], [], _PAD
    starts = []
    for t, ls in enumerate(split):
        for k, x in enumerate(ls):
            s = x.rstrip()
            if s and not kinds[t][k]:
                parts.append(s + "\n")
                starts.append(size)
                owner.append((t, k))
                size += len(s) + 1
        parts.append("\n\n")
        size += 2
    parts.append("\n" * _PAD)
    stream = "".join(parts)
    cp = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(gate[np.minimum(cp, 0xFFFF)])
    op = np.zeros(len(cp), np.int32)
    for i in range(0, len(at), 50_000):
        a = at[i : i + 50_000]
        x = windows(cp, a)
        score = m.chars[x[:, 0]].astype(np.float32)
        for c in range(1, x.shape[1]):
            score += m.chars[x[:, c]]
        op[a] = score.argmax(1)
    # joins: check each and note the line
    begin = np.array(starts, np.int64)
    line_of = lambda i: int(np.searchsorted(begin, i, "right")) - 1
    joined = np.zeros(len(cp), bool)
    for i in np.flatnonzero(op == JOIN):
        i = int(i)
        if stream[i + 1] == "\n" and _divides(stream, i, m):
            joined[i] = True
            t, k = owner[line_of(i)]
            kinds[t][k].add("hyphen")
    op[op == JOIN] = KEEP
    edits = _checked(stream, op, joined, names, m)
    for i in edits:
        t, k = owner[line_of(i)]
        kinds[t][k].add("glyph")
    return [Repaired(kinds[t], _rebuilt(split[t], kinds[t], [(starts[j], k2) for j, (t2, k2) in _of(owner, t)], stream, edits, joined)) for t in range(len(texts))]


def _of(owner: list[tuple[int, int]], t: int) -> Iterator[tuple[int, tuple[int, int]]]:
    """The lines of text t; owners are in order of texts."""
    import bisect

    i = bisect.bisect_left(owner, (t, -1))
    while i < len(owner) and owner[i][0] == t:
        yield i, owner[i]
        i += 1


def _divides(stream: str, i: int, m: Model) -> bool:
    """Whether the mark at i, before a line end, divides a word."""
    a = i
    while a > 0 and (stream[a - 1].isalnum() or stream[a - 1] in "@!+'’") and not _KANA.match(stream[a - 1]):
        a -= 1
    b = i + 2
    while b < len(stream) and (stream[b].isalnum() or stream[b] in "@!+'’") and not _KANA.match(stream[b]):
        b += 1
    left, right = stream[a:i], stream[i + 2 : b]
    if not left or not right or not left[-1].isascii() or right[0].isupper():
        return False
    if left.isdigit() or right.isdigit():
        return False
    whole = (left + right).lower()
    if whole in m.lexicon:
        return True
    return left.lower() not in m.lexicon or right.lower() not in m.lexicon or stream[i] not in "-‐‑"


def _checked(stream: str, op: np.ndarray, joined: np.ndarray, names: list[str], m: Model) -> dict[int, str]:
    """The edits that pass the exact check: position to what stands there instead."""
    edits: dict[int, str] = {}
    done = -1
    for i in np.flatnonzero(op > JOIN):
        i = int(i)
        if i <= done:
            continue
        c = stream[i]
        japanese = any(_KANA.match(x) for x in (stream[i - 1], c, stream[i + 1])) or names[op[i]][1] > "　"
        if japanese:
            new, n = names[op[i]][1:], next((len(r) for t, r in MISREAD if t == names[op[i]][1:] and stream.startswith(r, i)), 0)
            if n and _fits(stream, i, n, new, op, names, m):
                edits[i] = new
                for j in range(1, n):
                    edits[i + j] = ""
                done = i + n - 1
            continue
        # the whole word, over a division mark
        a = i
        while _inword(stream, a - 1) or (stream[a - 1] == "\n" and joined[a - 2]) or joined[a - 1]:
            a -= 1
        z = i + 1
        while _inword(stream, z) or joined[z] or (stream[z] == "\n" and joined[z - 1]):
            z += 1
        done = z - 1
        spots = [j for j in range(a, z) if not joined[j] and stream[j] != "\n"]
        old = "".join(stream[j] for j in spots)
        core = old.strip("!'’").lower()
        if core in m.lexicon or not any(x.isalpha() for x in old):
            continue
        got = _mended(stream, spots, op, names, m)
        if got:
            edits.update(got)
    return edits


def _inword(stream: str, j: int) -> bool:
    c = stream[j]
    return (c.isalnum() or c in "@!+'’") and not _KANA.match(c)


def _mended(stream: str, spots: list[int], op: np.ndarray, names: list[str], m: Model) -> dict[int, str] | None:
    """The edits of a word if they make one that is known; if not all do, a part of them."""
    edits: dict[int, str] = {}
    for j in spots:
        n = names[op[j]]
        if n[0] in "=+":
            edits[j] = n[1:]
        elif n == "delete":
            edits[j] = ""
    text = "".join(edits.get(j, stream[j]) for j in spots)
    if text.strip("!'’").lower() in m.lexicon:
        return edits
    # a closing exclamation mark stays one
    if spots and stream[spots[-1]] == "!":
        less = {j: e for j, e in edits.items() if j != spots[-1]}
        if less and "".join(less.get(j, stream[j]) for j in spots[:-1]).lower() in m.lexicon:
            return less
    # the editor may have seen only a part of the misreadings: known words of the same look complete it
    old = "".join(stream[j] for j in spots).lower()
    fixed = _same_look(old, m)
    return {spots[j]: e for j, e in fixed.items()} if fixed else None


def _same_look(word: str, m: Model) -> dict[int, str] | None:
    """The fewest changes that turn a word into a known one of the same look; of equals the most common word."""
    best = None
    # a closing mark may be a letter or none
    for w in dict.fromkeys((word, word.rstrip("!'’"))):
        for known in m.looks.get(look(w), ()):
            e = _changes(w, known)
            if e and (best is None or len(e) < len(best)):
                best = e
    return best


def _changes(a: str, b: str) -> dict[int, str]:
    """What stands where in ``a`` to make it ``b``, two words of one look: they are cut where the parts of both are."""
    parts = _looks()
    out: dict[int, str] = {}
    i = j = done = 0
    ends = [0]
    for c in b:
        ends.append(ends[-1] + len(parts.get(c, c)))
    at, from_i = 0, 0
    for i, c in enumerate(a):
        at += len(parts.get(c, c))
        while j < len(b) and ends[j] < at:
            j += 1
        if ends[j] == at:
            if a[from_i : i + 1] != b[done:j]:
                out |= {k: "" for k in range(from_i, i + 1)} | {from_i: b[done:j]}
            from_i, done = i + 1, j
    return out


def _fits(stream: str, i: int, n: int, new: str, op: np.ndarray, names: list[str], m: Model) -> bool:
    """Whether the Japanese text around i is known with the edit and isn't without it."""

    def side(j: int, step: int) -> str:
        out = []
        while len(out) < 2 and 0 < j < len(stream) - 1:
            c = stream[j]
            if c == "\n":
                if stream[j + step] == "\n":
                    break
            elif op[j] > JOIN and names[op[j]][0] == "=":
                out.append(names[op[j]][1:])
            elif op[j] != DELETE:
                out.append("0" if c.isdigit() else c)
            j += step
        return "".join(out if step > 0 else out[::-1])

    if not stream[i].isdigit() and stream[i] not in m.letters:
        return True
    a, z = side(i - 1, -1), side(i + n, 1)
    text = a + new + z
    seen = [_packed(text[k : k + 3]) in m.trigrams for k in range(len(text) - 2)]
    old = a[-1:] + ("0" if stream[i].isdigit() else stream[i]) + (("0" if stream[i + 1].isdigit() else stream[i + 1]) if n > 1 else z[:1])
    if len(old) == 3 and _packed(old) in m.trigrams:
        return False
    return bool(seen) and sum(seen) * 2 >= len(seen)


def _packed(s: str) -> int:
    return (ord(s[0]) << 42) | (ord(s[1]) << 21) | ord(s[2])


def _rebuilt(lines: list[str], kinds: list[set[str]], spans: list[tuple[int, int]], stream: str, edits: dict[int, str], joined: np.ndarray) -> str:
    """Paragraphs of the text: furniture out, divided words and lines joined, misreadings mended."""
    out: list[str] = []
    glue = True
    at = {k: s for s, k in spans}
    for k, line in enumerate(lines):
        if kinds[k] & {"header", "pageno"}:
            continue
        if k not in at:
            if out and out[-1] != "\n\n":
                out.append("\n\n")
            glue = True
            continue
        s, size = at[k], len(line.rstrip())
        text = "".join(edits.get(j, stream[j]) for j in range(s, s + size) if not joined[j])
        if not glue and out and not (_KANA.match(text[:1]) or _KANA.match(out[-1][-1:]) or out[-1][-1:] in "、。（"):
            out.append(" ")
        out.append(text)
        glue = bool("hyphen" in kinds[k])
    return "".join(out).strip("\n")


# --- frames -------------------------------------------------------------------------------------------


def clean_sample(docs: DataFrame, most: int = SAMPLE) -> list[str]:
    """The texts of at most ``most`` documents, those with the smallest hashes, whole.

    A share of the documents a little larger than needed is picked by hash before it is sorted, so that what
    is moved doesn't grow with the table.
    """
    n = max(1, docs.count())
    slots = 1 << 30
    upto = min(slots, int(slots * 1.3 * (most + 100) / n))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    picked = docs.select("doc_id", "text", h.alias("h")).filter((F.col("h") < upto) & F.expr("text is not null and text <> ''"))
    out, size = [], 0
    for r in picked.orderBy("h", "doc_id").limit(most).collect():
        out.append(r.text)
        size += len(r.text)
        if size > SAMPLE_CHARS:
            break
    return out


def known_text(docs: DataFrame) -> tuple[dict[str, int], frozenset]:
    """The words, with counts, and the trigrams that all documents together have twice and once in RARE.

    Counts are summed per batch before they are shuffled. What is collected is bounded: at most RARE of each kind, and by
    far less as words go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            words = word_counts(texts)
            grams, n = trigram_counts(texts)
            size, total = len(words), sum(words.values())
            # an empty word carries the sums
            yield pa.RecordBatch.from_arrays(
                [pa.array([*words, *[None] * len(grams), "", None]), pa.array([None] * size + grams.tolist() + [None, 0], pa.int64()), pa.array([*words.values(), *n.tolist(), total, int(n.sum())], pa.int64())], names=["word", "gram", "n"]
            )

    counts = checkpointed(spread(docs.select("text")).mapInArrow(run, "word string, gram bigint, n bigint").groupBy("word", "gram").agg(F.sum("n").alias("n")))
    sums = counts.filter("word = '' or gram = 0").agg(F.max(F.when(F.col("word") == "", F.col("n"))).alias("_w"), F.max(F.when(F.col("gram") == 0, F.col("n"))).alias("_g"))
    least = F.greatest(F.lit(2), F.ceil(F.when(F.col("word").isNotNull(), F.col("_w")).otherwise(F.col("_g")) / RARE))
    kept = counts.join(F.broadcast(sums)).filter((F.col("n") >= least) & F.expr("not (word <=> '') and not (gram <=> 0)")).select("word", "gram", "n").collect()  # one row of sums
    return {r.word: r.n for r in kept if r.word is not None}, frozenset(r.gram for r in kept if r.word is None)


def page_texts(scans: DataFrame, last: DataFrame) -> DataFrame:
    """(field, row_id, pass_no, text) of every page text."""
    raw = scans.select(F.lit("scan_log.raw").alias("field"), F.col("rec_id").alias("row_id"), F.posexplode("raw.text").alias("pass_no", "text"))
    section = scans.select(F.lit("scan_log.section").alias("field"), F.col("rec_id").alias("row_id"), F.lit(-1).alias("pass_no"), F.col("section").alias("text")).filter("contains(text, '\n')")
    whole = last.select(F.lit("last_scans.raw_text").alias("field"), F.col("row_id").alias("row_id"), F.lit(-1).alias("pass_no"), F.col("raw_text").alias("text"))
    return raw.unionAll(section).unionAll(whole).filter("text is not null")


def _repairs(texts: DataFrame, model: Model, schema: str, emit) -> DataFrame:
    texts = texts.select("field", "row_id", "pass_no", "text").filter("text is not null")
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield emit(part, repair(part.column(3).to_pylist(), m))

    return spread(texts).mapInArrow(run, schema)


def noisy_lines(texts: DataFrame, model: Model) -> DataFrame:
    """(field, row_id, pass_no, line_no, kind) of every line with noise."""

    def emit(part: pa.RecordBatch, done: list[Repaired]) -> pa.RecordBatch:
        rows = [(i, k, kind) for i, r in enumerate(done) for k, kinds in enumerate(r.kinds) for kind in sorted(kinds)]
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in range(3)), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["field", "row_id", "pass_no", "line_no", "kind"])

    return _repairs(texts, model, "field string, row_id bigint, pass_no int, line_no int, kind string", emit)


def repaired_texts(texts: DataFrame, model: Model) -> DataFrame:
    """(field, row_id, pass_no, text) in continuous paragraphs."""

    def emit(part: pa.RecordBatch, done: list[Repaired]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), pa.array([r.text for r in done], pa.string())], names=["field", "row_id", "pass_no", "text"])

    return _repairs(texts, model, "field string, row_id bigint, pass_no int, text string", emit)
