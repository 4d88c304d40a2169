"""Pages of repeated keywords, links or product tags instead of text.

Every document gets the share of its characters that stand in sentences (an end mark, and function
words, learnt for each language, or particles where it is written without spaces), and, of what is left over, how much it looks stuffed:
share of repeated character n-grams (``gram``), of repeated list items or lines (``dup``), of items with
the same head (``head``), of link markup (``link``), of tags (``tag``), of items between navigation
separators (``nav``), of items full of numbers (``num``), and of the most common word (``word``).

The limit of each measure is calibrated per language: a high quantile of it among all documents of the
language that are partly sentences (ingredient lists and recipes among them) or wholly, with a margin. It is counted, not estimated.
A page is stuffed if sentences are less than ``PROSE`` of it and one measure is above its limit.

Defined results: null and empty texts and texts too short to repeat anything are no case;
null languages are told by script; documents of any length are measured whole; repeated texts
each count. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, spread

#: Sentences must be less than this share of a stuffed page.
PROSE = 0.40
#: Documents from this share of sentences calibrate the limits.
CALIBRATES = 0.30
#: Text is no sentences at all where repeated n-grams make up more than SAME of it and one n-gram alone COVER.
SAME, COVER = 0.25, 0.09
#: Limits where nothing calibrates them (no document of the language is partly sentences).
FLOOR = {"gram": 0.15, "dup": 0.20, "head": 0.30, "link": 0.22, "tag": 0.30, "nav": 0.50, "num": 0.50, "word": 0.25}
#: A limit is this quantile among the calibrating documents, times MARGIN, but no less than LEAST. Measures are counted to so many decimals.
QUANTILE, MARGIN, LEAST, DECIMALS = 0.995, 1.5, 0.15, 4
#: A sentence has a function word for so many words at least, and fewer commas than one for so many words (in Japanese:
#: particles and commas for so many characters); short ones may have two.
PER_FUNCTION, PER_COMMA, PER_PARTICLE, PER_TOUTEN = 20, 3, 40, 6

_LINK = re.compile(r"<a\s[^>]*>|</a>|\]\([^)\s]*\)|https?://\S+|www\.\S+")
_SENTENCE = re.compile(r"[^.。!?！？\n|»#]+([。！？]|[.!?](?![^\W_]))?")
_ITEM = re.compile(r"\s*[\n|/»>·・•,、，;；\t　]\s*|\s-\s|\s#|^#|\s{2,}")
_ITEM_CJK = re.compile(_ITEM.pattern + r"|\s")
_UNIT = re.compile(r"[.!?,;:|»>·•/\n\t#()\[\]]+")
_NAV = re.compile(r"[»>·|•/]")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
# Particles, between a word and the next.
_PARTICLE = re.compile("(?<=[一-鿿ァ-ヶーぁ-ん])[はがをにでとのも]")
#: A word is learnt as a function word of a language if this share of its documents (and so many) have it, nearly all of it in units of
#: so many words.
COMMON, DOCUMENTS, LONG_SHARE, LONG_UNIT = 0.2, 50, 0.9, 6
# A few function words to begin with, of two languages written with spaces.
FUNCTION = frozenset((
    "the a an of to in is are was were be and or not for with that this it on at by from as we you they do has have had our i "
    "yang dan di ke dari untuk dengan ini itu pada adalah tidak sudah akan oleh karena atau juga setelah agar sehingga bahwa kami sebelum lalu sampai beberapa hanya sebanyak belum masih lebih selama menurut tetapi"
).split())


@cache
def _is_letter() -> np.ndarray:
    """Whether a code point is a letter or mark that words are made of."""
    return np.array([chr(c).isalnum() and not chr(c).isdecimal() and not chr(c).isdigit() for c in range(0x20000)] + [True] * (0x110000 - 0x20000))


def letters(text: str) -> np.ndarray:
    """The letters of a text as code points, in lower case."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return x[_is_letter()[x]]


def in_cjk(x: np.ndarray) -> bool:
    """Whether the letters of a whole text are largely kana and kanji."""
    return len(x) > 0 and bool((x >= 0x3040).mean() > 0.3)


def repetition(x: np.ndarray, n: int) -> tuple[float, float]:
    """The share of letter n-grams seen four times or more, and what the most common one covers."""
    x = x.astype(np.uint64)
    if len(x) < 4 * n:
        return 0.0, 0.0
    h = np.zeros(len(x) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + x[i : len(x) - n + 1 + i]
    h.sort()
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    count = np.diff(cut)
    return float(count[count >= 4].sum() / len(h)), float(count.max() * n / len(x))


FIELDS = ["doc_id", "lang", "prose", *FLOOR]
SCHEMA = "doc_id bigint, lang string, prose double, " + ", ".join(f"{k} double" for k in FLOOR)


def measure(text: str, function: frozenset[str] = FUNCTION) -> list[float]:
    """The share of sentences, then the stuffing measures in the order of FLOOR."""
    n = len(text)
    bare = _LINK.sub(" ", text)
    x = letters(bare)
    cjk = in_cjk(x)
    size = 5 if cjk else 6
    same, cover = repetition(x, size)
    rest, prose, last = [], 0, 0
    for m in _SENTENCE.finditer(bare) if same <= SAME or cover <= COVER else ():
        s = m.group()
        if m.group(1) is None or len(s) <= 12:
            continue
        if cjk:
            if s.count("、") > max(2, len(s) / PER_TOUTEN) or len(_PARTICLE.findall(s)) * PER_PARTICLE < len(s):
                continue
        else:
            size = s.count(" ") + 1
            if s.count(",") > max(2, size / PER_COMMA) or sum(w in function for w in _WORD.findall(s.lower())) * PER_FUNCTION < size:
                continue
        prose += len(s)
        rest.append(bare[last : m.start()])
        last = m.end()
    share = prose / n
    rest.append(bare[last:])
    r = "\n".join(rest)
    items = [x for x in (y.strip() for y in (_ITEM_CJK if cjk else _ITEM).split(r)) if len(x) > 1]
    k = len(items)
    lines = [x for x in _ITEM.split(r) if len(x.strip()) > 1]
    link = (n - len(bare)) / n
    gram, _ = repetition(letters(r), size)
    words = _WORD.findall(r.lower())
    word = Counter(words).most_common(1)[0][1] / len(words) if len(words) >= 10 else 0.0
    if k < 3:
        return [share, gram, 0.0, 0.0, link, 0.0, 0.0, 0.0, word]
    heads = Counter(x[:3] if _CJK.match(x) else " ".join(x.lower().split()[:2]) for x in items)
    return [
        share,
        gram,
        1 - len(set(items)) / k if k >= 5 else 0.0,
        heads.most_common(1)[0][1] / k if k >= 5 else 0.0,
        link,
        r.count("#") / k,
        len(_NAV.findall(r)) / k if k >= 5 else 0.0,
        sum(len(re.findall(r"\d+", x)) >= 2 for x in lines) / len(lines) if len(lines) >= 4 else 0.0,
        word,
    ]


def function_words(src: DataFrame) -> dict[str, frozenset[str]]:
    """The function words of each language, from (doc_id, lang, text): common words that hardly stand in short units.

    Counts over all documents, summed a batch at a time. A kept word is in a fifth of the documents of its language, so what
    is collected has a few times the words of one document for each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs: Counter = Counter()
            every: Counter = Counter()
            long: Counter = Counter()
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                docs[lang, ""] += 1
                if in_cjk(letters(text)):
                    continue
                seen = set()
                for unit in _UNIT.split(text.lower()):
                    words = _WORD.findall(unit)
                    seen.update(words)
                    for w in words:
                        every[lang, w] += 1
                        if len(words) >= LONG_UNIT:
                            long[lang, w] += 1
                for w in seen:
                    docs[lang, w] += 1
            keys = list(docs)
            cols = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + [pa.array([c[k] for k in keys], pa.int64()) for c in (docs, every, long)]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "word", "docs", "n", "long"])

    counts = checkpointed(src.mapInArrow(run, "lang string, word string, docs bigint, n bigint, long bigint").groupBy("lang", "word").agg(*[F.sum(c).alias(c) for c in ("docs", "n", "long")]))
    size = counts.filter("word = ''").select("lang", F.col("docs").alias("all"))
    kept = counts.filter("word <> ''").join(F.broadcast(size), "lang").filter((F.col("docs") >= F.greatest(COMMON * F.col("all"), F.lit(DOCUMENTS))) & (F.col("long") >= LONG_SHARE * F.col("n")))
    out: dict[str, set[str]] = {}
    for r in kept.select("lang", "word").collect():
        out.setdefault(r.lang, set()).add(r.word)
    return {k: FUNCTION | v for k, v in out.items()}


def measured(df: DataFrame) -> DataFrame:
    """The measures of every document."""
    lang = F.coalesce(F.col("lang"), F.when(F.col("text").rlike("[぀-ヿ㐀-鿿]"), "ja").otherwise("other"))
    src = spread(df.select("doc_id", lang.alias("lang"), "text").filter("text is not null and text <> ''"))
    shared = src.sparkSession.sparkContext.broadcast(function_words(src))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = shared.value
            rows = [measure(t, known.get(k, FUNCTION)) for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            cols = [pa.array([r[c] for r in rows], pa.float64()) for c in range(len(FIELDS) - 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=FIELDS)

    return src.mapInArrow(run, SCHEMA)


def limits_of(m: DataFrame) -> DataFrame:
    """(lang, max_...): the limits, from the measures of all documents that calibrate them."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(k, DECIMALS).alias("v")) for k in FLOOR])).alias("x")
    counts = m.filter(F.col("prose") >= CALIBRATES).select("lang", each).groupBy("lang", "x.k", "x.v").agg(F.count("*").alias("n"))
    # few values of each measure, whatever the number of documents
    every = Window.partitionBy("lang", "k")
    high = counts.withColumn("upto", F.sum("n").over(every.orderBy("v"))).withColumn("all", F.sum("n").over(every)).filter(F.col("upto") >= QUANTILE * F.col("all"))
    return high.groupBy("lang").agg(*[F.greatest(MARGIN * F.min(F.when(F.col("k") == k, F.col("v"))), F.lit(LEAST)).alias(f"max_{k}") for k in FLOOR])


def stuffed_pages(df: DataFrame) -> DataFrame:
    """The measures of the stuffed pages, with ``reason``, the measures above their limits."""
    m = checkpointed(measured(df))
    limits = limits_of(m)
    # one row for each language, of which there are few: broadcast, as a language may have most of the rows
    both = m.join(F.broadcast(limits), "lang", "left")
    over = {k: F.col(k) > F.coalesce(F.col(f"max_{k}"), F.lit(v)) for k, v in FLOOR.items()}
    reason = F.concat_ws(" ", *[F.when(c, F.lit(k)) for k, c in over.items()])
    return both.withColumn("reason", reason).filter((F.col("prose") < PROSE) & (F.col("reason") != "")).select(*FIELDS, "reason")
