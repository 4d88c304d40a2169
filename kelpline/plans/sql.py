"""SQL text for the same expressions, from the same configuration."""

from __future__ import annotations

from ..functions import text, tokens


#: White space at either end; white space, digits and percent signs at either end.
ENDS = f"^{text.WS}+|{text.WS}+\\z"
NUMBERED = r"^[\s　0-9０-９%％.]+|[\s　0-9０-９%％.]+\z"


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def drop(e: str, pattern: str, to: str = "") -> str:
    """All matches of a pattern replaced."""
    return f"regexp_replace({e}, {q(pattern)}, {q(to)}, 'g')"


def folded(e: str) -> str:
    """Phrase and character folds."""
    for a, b in text.PHRASES:
        e = f"replace({e}, {q(a)}, {q(b)})"
    return f"translate({e}, {q(text.VARIANTS[0])}, {q(text.VARIANTS[1])})"


def normalized(e: str, folds: bool = True) -> str:
    """The matching key of a term, without NFKC."""
    e = drop(e, text.WS)
    e = f"lower({folded(e) if folds else e})"
    return drop(drop(e, text.PUNCTUATION_JA), text.PUNCTUATION)


def surface(e: str) -> str:
    """Look-alikes folded, no white space, lower case."""
    return f"lower(translate({drop(e, text.WS)}, {q(text.LOOKALIKE[0])}, {q(text.LOOKALIKE[1])}))"


def core(e: str) -> str:
    """The part before the first bracket."""
    return f"CASE WHEN regexp_matches({e}, '^[^(（\\[［【]+[(（\\[［【]') THEN regexp_extract({e}, '^([^(（\\[［【]+)', 1) ELSE {e} END"


def code(e: str) -> str:
    """An additive code."""
    bare = f"upper({drop(e, '[^0-9A-Za-z]')})"
    return f"CASE WHEN {bare} = '' THEN NULL ELSE 'E' || regexp_replace({bare}, '^E', '') END"


def candidates(e: str) -> str:
    """Candidate terms in order."""
    plain = drop(drop(e, tokens.BORDERS), tokens.CONJUNCTIONS, "、")
    heads, inners = (f"regexp_extract_all({plain}, {q(tokens.NAMED)}, {i})" for i in (1, 2))
    named = f"flatten(list_transform(range(1, len({heads}) + 1), lambda i: [{inners}[i], {heads}[i] || {inners}[i]]))"
    segments = f"list_filter(list_transform(regexp_split_to_array({plain}, {q(tokens.DELIMITERS)}), lambda s: {drop('s', ENDS)}), lambda s: s <> '')"
    parted = f"flatten(list_transform({segments}, lambda s: CASE WHEN regexp_matches(s, {q(text.WS)}) THEN list_concat([s], regexp_split_to_array(s, {q(text.WS + '+')})) ELSE [s] END))"
    bare = f"list_transform(list_concat({named}, {parted}), lambda s: regexp_replace(s, {q(tokens.PACKAGING)}, ''))"
    singles = ", ".join(map(q, tokens.SINGLES))
    return f"list_filter({bare}, lambda s: length(s) >= 2 OR s IN ({singles}))"


def corpus_tokens(e: str) -> str:
    """Tokens for corpus statistics."""
    seg = f"regexp_split_to_array({e}, '[、。，．,;；:：・/／\n()（）\\[\\]［］]')"
    both = f"flatten(list_transform({seg}, lambda s: list_concat([s], regexp_split_to_array(s, {q(text.WS + '+')}))))"
    bare = f"list_transform({both}, lambda s: {drop('s', NUMBERED)})"
    return f"list_filter({bare}, lambda s: length(s) BETWEEN 2 AND 20 AND NOT regexp_matches(s, '[0-9０-９]') AND regexp_matches(s, '[぀-ヿ㐀-鿿]'))"


def strictness(e: str) -> str:
    """The rank of a status."""
    return f"CASE {e} WHEN 'haram' THEN 1 WHEN 'syubhat' THEN 2 WHEN 'unknown' THEN 3 WHEN 'halal' THEN 4 ELSE 5 END"
