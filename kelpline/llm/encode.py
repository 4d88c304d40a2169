"""Encoding of a corpus with a public byte-level BPE tokenizer.

A text of more than LEAF characters is halved recursively and the halves are encoded on their own; neighbours are joined up the
tree. A join re-encodes only a window around the seam. The window grows until it reaches, on both sides,
a place where every scan of the tokenizer's split pattern must stop: before white space that follows
another character, or between a letter and a non-letter, or between a number and a non-number. No
alternative of the pattern crosses such a place whatever stands around it, so tokens outside the
window can't change, and the join is associative. Where a half has no such place the window is all of it.

Defined results: null and empty texts give an empty list; special tokens' names are ordinary text;
repeated texts give equal rows; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Texts up to this many characters are the leaves of the tree.
LEAF = 256
# The white space of the split pattern (Unicode's White_Space).
SPACE = frozenset(chr(c) for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public tokenizer's file is installed."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


class Encoder:
    """The monoid of encoded texts for one vocabulary of ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # The split pattern of byte-level BPE as published with the vocabulary.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.leaf = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.width = [0] * (max(ranks.values()) + 1)
        self.words = [b""] * len(self.width)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
            self.words[rank] = token

    @staticmethod
    def _stops(left: str, right: str) -> bool:
        """Whether every scan stops between these two characters."""
        if right in SPACE:
            return left not in SPACE
        if left in SPACE:
            return False
        if _letter(left):
            return not _letter(right)
        return _number(left) and not _number(right)

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """Token ids of a text."""
        if len(text) <= leaf:
            return self.leaf(text)
        mid = len(text) // 2
        return self.join(text[:mid], self.encode(text[:mid], leaf), text[mid:], self.encode(text[mid:], leaf))

    def join(self, a: str, ida: list[int], b: str, idb: list[int]) -> list[int]:
        """The encoding of a + b from those of a and b."""
        p, q = len(a) - 1, 1
        while p > 0 and not self._stops(a[p - 1], a[p]):
            p -= 1
        while q < len(b) and not self._stops(b[q - 1], b[q]):
            q += 1
        p = max(p, 0)
        keep_a = self._tokens(ida[::-1], len(a[p:].encode("utf-8", "surrogatepass")))
        keep_b = self._tokens(idb, len(b[:q].encode("utf-8", "surrogatepass")))
        return ida[: len(ida) - keep_a] + self.leaf(a[p:] + b[:q]) + idb[keep_b:]

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        """The bytes of token ids; those of halves are concatenated up the tree."""
        if len(ids) <= leaf:
            return b"".join([self.words[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)

    def _tokens(self, ids: list[int], size: int) -> int:
        """How many of the first ids make up ``size`` bytes."""
        k = 0
        while size > 0:
            size -= self.width[ids[k]]
            k += 1
        assert size == 0
        return k


def _letter(c: str) -> bool:
    return unicodedata.category(c)[0] == "L"


def _number(c: str) -> bool:
    return unicodedata.category(c)[0] == "N"


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(key, ids) of every row."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            ids = [e.encode(t, leaf) if t else [] for t in batch.column(1).to_pylist()]
            offs = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offs[1:])
            flat = np.fromiter((i for x in ids for i in x), np.int32, offs[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_sizes(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have 0 tokens."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            n = [len(e.encode(t, leaf)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text) of every row of token ids; bytes that are no text become replacement characters, null ids an empty text."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = [e.decode(x).decode("utf-8", "replace") if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
