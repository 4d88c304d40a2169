"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space with the wide and no-break forms that Java's \s lacks.
WS = r"[\s\x0B   -     　﻿]"
PUNCTUATION_JA = r"[、。，．・：；（）［］「」『』【】〈〉《》｛｝〔〕ー〜…※★☆◆◇■□●○]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"

#: Our own small fold tables; callers pass theirs.
PHRASES = [("デンプン", "澱粉"), ("でんぷん", "澱粉"), ("たん白", "蛋白"), ("たんぱく", "蛋白"), ("powdered", "powder")]
VARIANTS = ("蛋麵鹽醬糀黃", "蛋麺塩醤麹黄")
#: Characters a scanner mixes up, folded to one of each class for comparisons.
LOOKALIKE = ("0ｏOlI|1へべぺ一―‐", "oooiiiiヘベペーーー")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normal form, one Arrow batch at a time; there is no built-in."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)


def squeezed(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, WS, "")


def folded(c: Column, phrases: list[tuple[str, str]] | None = None, variants: tuple[str, str] | None = None) -> Column:
    """Phrase folds in order, then one-to-one character folds."""
    for a, b in PHRASES if phrases is None else phrases:
        c = F.replace(c, F.lit(a), F.lit(b))
    a, b = variants or VARIANTS
    return F.translate(c, a, b)


def normalized(c: Column, folds: bool = True, compat: bool = True) -> Column:
    """The matching key of a term: NFKC, no white space, folds, lower case, no punctuation, in this order.

    Null stays null; a term of punctuation only becomes the empty string, which means "no term".
    ``folds=False`` is the form dictionaries are built with; ``compat=False`` leaves NFKC out, and the
    whole expression stays in the JVM.
    """
    c = squeezed(nfkc(c) if compat else c)
    c = F.lower(folded(c) if folds else c)
    return F.regexp_replace(F.regexp_replace(c, PUNCTUATION_JA, ""), PUNCTUATION, "")


def surface_form(c: Column) -> Column:
    """Look-alike characters folded, white space gone, lower case."""
    return F.lower(F.translate(squeezed(c), *LOOKALIKE))


def core_form(c: Column) -> Column:
    """The part before the first bracket, unless it would be empty."""
    at = F.regexp_instr(c, F.lit(r"[(（\[［【]"))
    return F.when(at > 1, F.substring(c, F.lit(1), at - 1)).otherwise(c)


def flat_form(c: Column) -> Column:
    """Without bracket characters, their content kept."""
    return F.regexp_replace(c, r"[()（）\[\]［］【】]", "")


def loose_form(c: Column) -> Column:
    """Core, flat, look-alike-folded and without amounts."""
    return F.regexp_replace(surface_form(flat_form(core_form(c))), r"[0-9.,]+(%|mg|kg|g|ml)?", "")


def norm_code(c: Column) -> Column:
    """An additive code as E and number: spelling marks gone, one E in front."""
    bare = F.upper(F.regexp_replace(c, r"[^0-9A-Za-z]", ""))
    return F.when(bare == "", None).otherwise(F.concat(F.lit("E"), F.regexp_replace(bare, "^E", "")))


def norm_status(c: Column, prefixes: list[tuple[str, str]], other: str = "unknown") -> Column:
    """The first prefix that a free-text status begins with decides."""
    low, out = F.lower(F.trim(c)), None
    for p, value in prefixes:
        out = F.when(low.startswith(p), value) if out is None else out.when(low.startswith(p), value)
    return out.otherwise(other)


def slug(c: Column, size: int = 24) -> Column:
    """Kana, kanji and ASCII letters and digits of the normal form, cut to size; ``x`` if none is left."""
    s = F.substring(F.regexp_replace(normalized(c, compat=False), r"[^0-9a-z぀-ヿ㐀-鿿]", ""), 1, size)
    return F.when(s == "", "x").otherwise(s)


def norm_path(c: Column) -> Column:
    """A path with forward slashes, trimmed, in lower case."""
    return F.lower(F.trim(F.replace(c, F.lit("\\"), F.lit("/"))))


def basename(c: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(norm_path(c), "/"), -1)


def finding_token(c: Column) -> Column:
    """``raw=status(entry)`` split at the last equals sign and brackets; null if it isn't of that form."""
    pattern = r"^(.+)=([^=]*)\(([^(]*)\)[^)]*$"
    parts = [F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]
    return F.when(c.rlike(pattern), F.struct(parts[0].alias("raw"), parts[1].alias("status"), parts[2].alias("entry_id")))


def percent(part: Column, whole: Column) -> Column:
    """A share in percent, rounded to one decimal; null if the whole is zero."""
    return F.when(whole != 0, F.floor(part / whole * 1000 + 0.5) / 10)


def source_text(*parts: Column, sep: str = " ") -> Column:
    """One text from the fields of a source given as a string or as a struct: blank and null ones left out."""
    return F.concat_ws(sep, *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that later filters use as it is.

    A filter on a plain column is pushed below it, with its expression written out at every place it is used; it can't
    be pushed below a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))
