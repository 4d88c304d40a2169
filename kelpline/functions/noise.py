"""Telling label boilerplate from ingredient terms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NoiseRules:
    """Word lists and patterns of boilerplate, for normalised terms. Ours are few; callers bring theirs."""

    words: tuple[str, ...] = ("電子版", "calories", "kcal", "個包装", "容器", "本体価格", "製造番号", "裏面に記載", "税別", "連絡先", "要冷蔵", "枠外参照", "見本品", "開封後はお早めに", "barcode", "serving", "netweight", "bestbefore", "lotnumber", "keepcool", "shelflabel", "telno")
    parts: str = r"(栄養成分|賞味期限|お問い合わせ|lotnumber|netweight|bestbefore|barcode|shelflabel|telno|製造番号|本体価格|連絡先)"
    address: str = r"(株式会社|有限会社|[都道府県市区町村]\d|番地|丁目)"
    units: str = r"(kcal|mg|kg|ml|cm|円|個入|jpy)"
    nutrition: str = r"(energy|protein|fat|脂質|炭水化物|食塩相当)"
    stems: str = r"(starch|broth|powder|syrup|澱粉|粉末|糖蜜|煮出汁)"
    allergen_mark: str = r"(含む|contains|一部)"
    allergens: str = r"(小麦|大豆|卵|乳|えび|かに|soy|wheat|milk|egg)"
    meat: str = r"(豚|牛|鶏|pork|beef|chicken)"
    claim: str = r"(使用していません|不使用|含まない|同じ設備|sameline|free)"


DEFAULT = NoiseRules()


def distinct_hits(c: Column, pattern: str) -> Column:
    """How many different matches of a one-group pattern a string has."""
    return F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1))))


def is_exact_noise(c: Column, r: NoiseRules = DEFAULT) -> Column:
    """The term is one of the boilerplate words."""
    return c.isin(*r.words)


def is_soup(c: Column, r: NoiseRules = DEFAULT) -> Column:
    """Run-together scan output: long, with digits, and nutrition words or two food stems."""
    return (F.length(c) >= 8) & c.rlike(r"\d") & (c.rlike(r.nutrition) | (distinct_hits(c, r.stems) >= 2))


def is_allergen_note(c: Column, r: NoiseRules = DEFAULT) -> Column:
    """A note that names allergens but no meat."""
    return c.rlike(r.allergen_mark) & ~c.rlike(r.meat) & (distinct_hits(c, r.allergens) >= 2)


def is_amount(c: Column, r: NoiseRules = DEFAULT) -> Column:
    """Digits and a unit."""
    return c.rlike(r"\d") & c.rlike(r.units)


def is_noise(c: Column, r: NoiseRules = DEFAULT) -> Column:
    """The cascade; the first rule that applies decides. The empty term is noise, null stays null.

    A term that names meat is noise only as a single mention inside a claim, as soup, or as an amount.
    """
    claim = (F.regexp_count(c, F.lit(r.meat)) == 1) & c.rlike(r.claim)
    return (
        F.when(c == "", True)
        .when(c.rlike(r.meat), claim | is_soup(c, r) | is_amount(c, r))
        .when(is_exact_noise(c, r), True)
        .when(c.rlike(r.parts) | c.rlike(r.address), True)
        .when(is_amount(c, r) | is_soup(c, r) | is_allergen_note(c, r), True)
        .otherwise(c.rlike(r"^[¥$]?\d"))
    )


def is_short_ascii(c: Column) -> Column:
    """One to five printable ASCII characters and nothing else."""
    return c.rlike(r"^[\x20-\x7e]{1,5}\z")


def any_name(names: Column, pattern: str) -> Column:
    """Whether a name of an array matches."""
    return F.coalesce(F.exists(names, lambda x: F.coalesce(x.rlike(pattern), F.lit(False))), F.lit(False))


def guarded(c: Column, marker: str, exceptions: tuple[str, ...]) -> Column:
    """The marker matches and no exception is contained."""
    hits = [F.contains(c, F.lit(x)) for x in exceptions]
    return c.rlike(marker) & ~reduce(lambda a, b: a | b, hits, F.lit(False))


def first_category(c: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The value of the first pattern that matches."""
    out = None
    for pattern, value in rules:
        out = F.when(c.rlike(pattern), value) if out is None else out.when(c.rlike(pattern), value)
    return out.otherwise(other)


def flags(conditions: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def valid_name(c: Column) -> Column:
    """A dictionary name: Japanese or a code, no placeholder, no printed object."""
    return c.rlike(r"([぀-ヿ㐀-鿿]|^[Ee]\d{3,4})") & ~c.isin("unknown", "n/a", "-", "") & ~F.contains(c, F.lit("[object Object]"))
