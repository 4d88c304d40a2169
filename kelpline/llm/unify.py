"""Visually identical text with different characters: bring text to one form.

An Arrow batch becomes one flat code-point array. A lookup table over all code points gives class and
plain form of each (full-width and half-width forms, ligatures, radicals, odd spaces, invisible marks);
expansion offsets make room for ligatures; combining marks are sorted by combining class and composed by binary
search over a table of (base, mark) pairs, pass by pass, so that canonically equal texts come out equal; letters of another script that look like Latin ones, and kanji or
hiragana that look like katakana, are folded where their neighbours show which script is meant. No
string is handled on its own.

Defined results: null stays null, the empty string stays empty; repeated values give repeated rows;
letter case, ordinary spaces and punctuation, spelling, usual accented letters (composed) and words truly
of another script stay as they are; texts of any length are handled whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.codepoints import Block, to_block, to_strings

# Invisible characters, and spaces that look like the ordinary one.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF]
SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
# Blocks whose compatibility forms look like the plain ones.
COMPATIBLE = [(0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0xFF01, 0xFFEE), (0x1D400, 0x1D7FF)]
# Letters of other scripts and the Latin letters they look like.
CYRILLIC = ("авеѕіјкмһоԛрстԝухԁ" "АВЕЅІЈКМНОРСТУХ", "abesijkmhoqpctwyxd" "ABESIJKMHOPCTYX")
GREEK = ("αικνορτυχ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aikvoptux" "ABEZHIKMNOPTYX")
ARMENIAN = ("օոսհցզ" "ՕՍԼՏ", "onuhgq" "OULS")
CHEROKEE = ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ")
# Characters with the look of another in every script.
ALWAYS = ("ɑɡı‐‑", "agi--")
#: Look-alikes hardly used in the languages a whole word of look-alikes could be of.
RARE = "ѕіјһԛԝԁЅІЈ"
# Characters that look like katakana.
KANA = ("一卜力口囗工夕二八へべぺ", "ートカロロエタニハヘベペ")
# Ordinary words in which such characters are kanji beside katakana.
WORDS = ("一部", "一番", "一度", "一種", "一般", "一口", "二度", "二番", "二種", "八分", "加工", "人工", "大工", "細工", "施工", "木工", "人口", "入口", "出口", "窓口", "甘口", "辛口", "能力", "圧力", "電力", "水力", "夕食", "夕方")

KEEP, DROP, SPACE, MAPPED, LATIN, OTHER, LOOK, RARELOOK, KATAKANA, KANALOOK = range(10)


@cache
def tables() -> dict[str, np.ndarray]:
    """The lookup tables, built from Unicode's own data and the fixed values above."""
    kind, to = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    wide: dict[int, list[int]] = {}
    for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)]:
        kind[c] = LATIN
    for a, z in ((0x370, 0x3FF), (0x400, 0x52F)):
        for c in range(a, z + 1):
            if unicodedata.category(chr(c))[0] == "L":
                kind[c] = OTHER
    kind[0x30A1:0x30FB] = KATAKANA
    kind[0x30FC] = KATAKANA
    for c in INVISIBLE:
        kind[c] = DROP
    for c in SPACES:
        kind[c], to[c] = SPACE, 0x20
    for a, z in COMPATIBLE:
        for c in range(a, z + 1):
            form = [ord(x) for x in unicodedata.normalize("NFKC", chr(c))]
            if form != [c]:
                kind[c], to[c] = MAPPED, form[0]
                if len(form) > 1:
                    wide[c] = form
    kind[0x2F00:0x2FE0][to[0x2F00:0x2FE0] != np.arange(0x2F00, 0x2FE0)] = MAPPED
    for src, dst in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE):
        for s, d in zip(src, dst, strict=True):
            kind[ord(s)], to[ord(s)] = LOOK, ord(d)
    for s in RARE:
        kind[ord(s)] = RARELOOK
    for s, d in zip(*ALWAYS, strict=True):
        kind[ord(s)], to[ord(s)] = MAPPED, ord(d)
    for s, d in zip(*KANA, strict=True):
        kind[ord(s)], to[ord(s)] = KANALOOK, ord(d)
    pairs: dict[int, int] = {}
    order = np.zeros(0x110000, np.uint8)
    parts: dict[int, list[int]] = {}
    for c in [*range(0xC0, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA1E)]:
        x = chr(c)
        order[c] = unicodedata.combining(x)
        d = unicodedata.decomposition(x)
        if not d or d[0] == "<":
            continue
        parts[c] = [ord(y) for y in unicodedata.normalize("NFD", x)]
        form = [ord(y) for y in unicodedata.normalize("NFC", x)]
        if form != [c]:
            kind[c], to[c] = MAPPED, form[0]
            if len(form) > 1:
                wide[c] = form
        elif len(p := [int(y, 16) for y in d.split()]) == 2:
            pairs[(p[0] << 21) | p[1]] = c
    keys = np.array(sorted(pairs), np.int64)
    marks = order > 0
    marks[np.unique(keys & 0x1FFFFF)] = True
    size, deep = np.ones(0x110000, np.int8), np.ones(0x110000, np.int8)
    for c, form in wide.items():
        size[c] = len(form)
    for c, form in parts.items():
        deep[c] = len(form)
    return {"kind": kind, "to": to, "size": size, "marks": marks, "keys": keys, "made": np.array([pairs[int(k)] for k in keys], np.uint32), "wide": wide, "order": order, "deep": deep, "parts": parts}


def _drop(b: Block, keep: np.ndarray) -> Block:
    upto = np.zeros(len(b.cp) + 1, np.int64)
    np.cumsum(keep, out=upto[1:])
    return Block(b.cp[keep], upto[b.start], b.null)


def _beside(x: np.ndarray, start: np.ndarray, fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The value before and after each position, within its row."""
    left, right = np.full_like(x, fill), np.full_like(x, fill)
    left[1:], right[:-1] = x[:-1], x[1:]
    inner = start[(start > 0) & (start < len(x))]
    left[inner] = fill
    right[inner - 1] = fill
    return left, right


def _widened(b: Block, at: np.ndarray, size: np.ndarray, forms: dict[int, list[int]]) -> Block:
    """The characters where ``at`` is true replaced by their ``forms``, with room made by expansion offsets."""
    size = np.where(at, size, 1).astype(np.int64)
    offs = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    out = np.repeat(b.cp, size)
    for c in np.unique(b.cp[at]):
        where = offs[:-1][at & (b.cp == c)]
        for k, x in enumerate(forms[int(c)]):
            out[where + k] = x
    return Block(out, offs[b.start], b.null)


def _differ(a: Block, b: Block) -> np.ndarray:
    """Which rows of two blocks are not equal."""
    na, nb = np.diff(a.start), np.diff(b.start)
    out = na != nb
    same = ~out
    ka, kb = np.repeat(same, na), np.repeat(same, nb)
    rows = a.rows[ka]
    out[rows[a.cp[ka] != b.cp[kb]]] = True
    return out


def _composed(b: Block) -> Block:
    """Combining marks in canonical order and composed with their letters, as normal form C has it; jamo to syllables.

    Letters before a mark are taken apart, the marks of each run are sorted stably by combining class in one lexsort, and
    letters take up their marks again pass by pass, each its first mark that isn't blocked by one of the same class.
    """
    t = tables()
    if t["marks"][b.cp].any():
        # only rows with marks are handled, as a block of their own
        rows = np.unique(b.rows[t["marks"][b.cp]])
        b = _with_rows(b, rows, _marks_composed(_rows_of(b, rows)))
    jamo = (b.cp >= 0x1161) & (b.cp <= 0x11C2)
    if jamo.any():
        for lead in (True, False):
            left, _ = _beside(b.cp.astype(np.int64), b.start)
            if lead:
                hit = (left >= 0x1100) & (left <= 0x1112) & (b.cp >= 0x1161) & (b.cp <= 0x1175)
                made = 0xAC00 + ((left - 0x1100) * 21 + (b.cp.astype(np.int64) - 0x1161)) * 28
            else:
                hit = (left >= 0xAC00) & (left < 0xD7A4) & ((left - 0xAC00) % 28 == 0) & (b.cp >= 0x11A8) & (b.cp <= 0x11C2)
                made = left + b.cp.astype(np.int64) - 0x11A7
            cp = b.cp.copy()
            cp[np.flatnonzero(hit) - 1] = made[hit]
            b = _drop(Block(cp, b.start, b.null), ~hit)
    return b


def _rows_of(b: Block, rows: np.ndarray) -> Block:
    pick = np.zeros(len(b.start) - 1, bool)
    pick[rows] = True
    size = np.diff(b.start)
    return Block(b.cp[np.repeat(pick, size)], np.concatenate([[0], np.cumsum(size[rows])]), b.null[rows])


def _with_rows(b: Block, rows: np.ndarray, part: Block) -> Block:
    """``b`` with the given rows replaced by those of ``part``."""
    size = np.diff(b.start)
    pick = np.zeros(len(size), bool)
    pick[rows] = True
    new = size.copy()
    new[rows] = np.diff(part.start)
    start = np.concatenate([[0], np.cumsum(new)])
    out = np.empty(start[-1], np.uint32)
    other = np.repeat(pick, new)
    out[other] = part.cp
    out[~other] = b.cp[~np.repeat(pick, size)]
    return Block(out, start, b.null)


def _marks_composed(b: Block) -> Block:
    t = tables()
    mark = t["marks"][b.cp]
    _, after = _beside(mark.astype(np.int8), b.start)
    b = _widened(b, (t["deep"][b.cp] > 1) & (mark | (after > 0)), t["deep"][b.cp], t["parts"])
    order = t["order"][b.cp].astype(np.int64)
    first = np.zeros(len(b.cp), bool)
    first[b.start[:-1][np.diff(b.start) > 0]] = True
    run = np.cumsum((order == 0) | first)
    left, _ = _beside(order, b.start)
    if ((left > order) & (order > 0)).any():
        b = Block(b.cp[np.lexsort((order, run))], b.start, b.null)
    dead = np.zeros(len(b.cp), bool)
    while len(b.cp):
        n = len(b.cp)
        order = t["order"][b.cp].astype(np.int64)
        first = np.zeros(n, bool)
        first[b.start[:-1][np.diff(b.start) > 0]] = True
        starter = (order == 0) | first
        before = np.arange(n) - 1
        # the letter of a mark is the last starter before it; of a second starter it is the character just before
        base = np.maximum.accumulate(np.where(starter, np.arange(n), 0))
        base = np.where(starter, before, base)
        free = ~first & ~dead & t["marks"][b.cp] & (base >= 0)
        free &= (before == base) | ((order > 0) & (order[before] < order))
        free &= starter[base] & (order[base] == 0)
        key = (b.cp[base].astype(np.int64) << 21) | b.cp
        at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        hit = np.flatnonzero(free & (t["keys"][at] == key))
        if not len(hit):
            return b
        # one mark for each letter and pass, and no letter that is a mark taken up in this pass
        hit = hit[np.unique(base[hit], return_index=True)[1]]
        taken = np.zeros(n, bool)
        taken[hit] = True
        hit = hit[~taken[base[hit]]]
        cp = b.cp.copy()
        cp[base[hit]] = t["made"][at[hit]]
        upto = np.full(n, -1)
        upto[base[hit]] = hit
        dead |= ~starter & (np.arange(n) < upto[np.maximum(base, 0)])
        keep = np.ones(n, bool)
        keep[hit] = False
        b, dead = _drop(Block(cp, b.start, b.null), keep), dead[keep]
    return b


def unify_block(b: Block) -> tuple[Block, np.ndarray]:
    """The block in plain characters, and for each row whether one had to be replaced."""
    t, nrow = tables(), len(b.start) - 1
    found = np.zeros(nrow, bool)

    def note(mask: np.ndarray) -> None:
        found[rows[mask]] = True

    rows, kind = b.rows, t["kind"][b.cp]
    if not len(b.cp):
        return b, found
    note(kind == DROP)
    b = _drop(b, kind != DROP)
    # plain forms, with room for ligatures
    rows, kind = b.rows, t["kind"][b.cp]
    note((kind == MAPPED) | (kind == SPACE))
    wide = t["size"][b.cp] > 1
    b = Block(np.where(((kind == MAPPED) | (kind == SPACE)) & ~wide, t["to"][b.cp], b.cp), b.start, b.null)
    if wide.any():
        b = _widened(b, wide, t["size"][b.cp], t["wide"])
    plain = _composed(b)
    if plain is not b:
        found |= _differ(b, plain)
        b = plain
    rows, kind = b.rows, t["kind"][b.cp]
    cp = b.cp.copy()
    # letters that look Latin, in words or values where Latin is meant
    look = (kind == LOOK) | (kind == RARELOOK)
    if look.any():
        letter = look | (kind == LATIN) | (kind == OTHER)
        left, _ = _beside(letter.astype(np.int8), b.start)
        word = np.cumsum(letter & (left == 0))
        latin_word, other_word, rare_word = (np.bincount(word[m], minlength=word[-1] + 1) > 0 for m in (kind == LATIN, letter & (kind == OTHER), kind == RARELOOK))
        latin_row, other_row = (np.bincount(rows[m], minlength=nrow) > 0 for m in (kind == LATIN, kind == OTHER))
        single = np.bincount(word[letter], minlength=word[-1] + 1) == 1
        greek = (b.cp >= 0x370) & (b.cp < 0x400)
        fold = look & ~other_word[word] & (latin_word[word] | rare_word[word] | (latin_row[rows] & ~other_row[rows] & ~(single[word] & greek)))
        cp[fold] = t["to"][b.cp[fold]]
        note(fold)
    # kanji and hiragana that look like katakana, beside katakana
    shape = kind == KANALOOK
    if shape.any():
        before, after = _beside(b.cp, b.start)
        meant = np.zeros(len(cp), bool)
        for x, y in WORDS:
            meant |= ((b.cp == ord(x)) & (after == ord(y))) | ((b.cp == ord(y)) & (before == ord(x)))
        kana = kind == KATAKANA
        open_ = shape & ~meant
        while True:
            left, right = _beside(kana.astype(np.int8), b.start)
            more = open_ & ~kana & ((left > 0) | (right > 0))
            if not more.any():
                break
            kana |= more
        fold = kana & shape
        cp[fold] = t["to"][b.cp[fold]]
        note(fold)
    return Block(cp, b.start, b.null), found


def unify_column(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A string column in plain characters, and where something had to be replaced."""
    b, found = unify_block(to_block(col))
    return to_strings(b.cp, b.start, b.null), found


def unified(df: DataFrame, column: str = "val") -> DataFrame:
    """The input with ``column`` in plain characters and a boolean ``was_mixed`` beside it.

    All other columns pass through; one called ``was_mixed`` is replaced.
    """
    df = df.drop("was_mixed")
    schema = StructType([*df.schema.fields, StructField("was_mixed", BooleanType())])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            val, found = unify_column(batch.column(at))
            cols = [val if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found)], names=[*batch.schema.names, "was_mixed"])

    return df.mapInArrow(run, schema)


def name_values(findings: DataFrame, entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(field, row_id, pos, val) of every token and name of the three tables."""
    raw = findings.select(F.lit("findings.raw").alias("field"), F.col("finding_id").alias("row_id"), F.lit(0).alias("pos"), F.col("raw").alias("val"))
    ie = entries.select(F.lit("ingredient_entries.names").alias("field"), F.col("entry_no").alias("row_id"), F.posexplode("names").alias("pos", "val"))
    ce = catalog.select(F.lit("catalog_entries.names").alias("field"), F.col("cat_no").alias("row_id"), F.posexplode("names").alias("pos", "val"))
    return raw.unionAll(ie).unionAll(ce).filter("val is not null")


def mixed_values(values: DataFrame) -> DataFrame:
    """(field, row_id, pos) of the values with a character its plain spelling doesn't have."""
    return unified(values).filter("was_mixed").select("field", "row_id", "pos")
