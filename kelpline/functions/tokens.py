"""Tokens of ingredient lists and of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .noise import is_noise
from .text import WS, computed_once, normalized

BORDERS = r"[│┃|｜┌┐└┘├┤┬┴┼─━═║]"
#: Conjunctions that part two items.
CONJUNCTIONS = r"(および|又は|または|ならびに|もしくは)"
DELIMITERS = r"[、。，．,;；:：・･､｡/／\n\t+＋()（）\[\]［］【】「」『』{}｛｝<>＜＞]"
#: One-character terms that count.
SINGLES = ("卵", "乳", "塩", "酢", "麦", "米", "糖")
# Words for what is packed beside the food, at the beginning of a candidate.
PACKAGING = r"^(添付|別添|付属|添付調味)"
#: A head with a named part in brackets, such as colourings.
NAMED = r"([^、，,・/／()（）\s]*(?:色素|香料))[(（]([^()（）]+)[)）]"


def candidates(text: Column) -> Column:
    """Candidate terms of a text in order, duplicates included.

    Named pairs come first, as inner name and as head with inner name; then every segment between
    delimiters, followed by its parts where it holds white space.
    """
    plain = F.regexp_replace(F.regexp_replace(text, BORDERS, ""), CONJUNCTIONS, "、")
    heads, inners = (F.regexp_extract_all(plain, F.lit(NAMED), F.lit(i)) for i in (1, 2))
    named = F.flatten(F.zip_with(heads, inners, lambda h, i: F.array(i, F.concat(h, i))))
    segments = F.transform(F.split(plain, DELIMITERS), lambda s: F.regexp_replace(s, f"^{WS}+|{WS}+\\z", ""))
    parted = F.flatten(F.transform(F.filter(segments, lambda s: s != ""), lambda s: F.when(s.rlike(WS), F.concat(F.array(s), F.split(s, f"{WS}+"))).otherwise(F.array(s))))
    bare = F.transform(F.concat(named, parted), lambda s: F.regexp_replace(s, PACKAGING, ""))
    return F.filter(bare, lambda s: (F.length(s) >= 2) | s.isin(*SINGLES))


def candidate_rows(df: DataFrame, key: str, text: str, compat: bool = True) -> DataFrame:
    """(key, ord, raw, term): the candidates of each text, the first of each normal form, without boilerplate."""
    rows = computed_once(df.select(key, F.posexplode(candidates(F.col(text))).alias("ord", "raw")), "term", normalized(F.col("raw"), compat=compat))
    rows = rows.filter((F.col("term") != "") & ~is_noise(F.col("term")))
    w = Window.partitionBy(key, "term").orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def corpus_tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Tokens for corpus statistics: segments and their parts, so a one-word segment counts twice."""
    segments = F.split(text, r"[、。，．,;；:：・/／\n()（）\[\]［］]")
    both = F.flatten(F.transform(segments, lambda s: F.concat(F.array(s), F.split(s, f"{WS}+"))))
    bare = F.transform(both, lambda s: F.regexp_replace(s, r"^[\s　0-9０-９%％.]+|[\s　0-9０-９%％.]+\z", ""))
    keep = F.filter(bare, lambda s: (F.length(s) >= 2) & (F.length(s) <= 20) & ~s.rlike(r"[0-9０-９]") & s.rlike(r"[぀-ヿ㐀-鿿]"))
    return F.filter(keep, lambda s: ~s.isin(*stop)) if stop else keep


def chunk_bigrams(s: Column) -> Column:
    """The distinct two-character chunks of a string, side by side, not overlapping."""
    starts = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(s, i, F.lit(2))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ > 0, both / all_).otherwise(0.0)


def sliding(s: Column, width: Column) -> Column:
    """All substrings of the given width, in order."""
    n = F.length(s) - width + 1
    return F.when((n > 0) & (width > 0), F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, width))).otherwise(F.array().cast("array<string>"))
