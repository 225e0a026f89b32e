"""Numbers of tokens of whole texts under a byte-level BPE vocabulary, by merging over a heap and a linked list.

A text is split at special strings and then into units (words, numbers, signs, white space) that no merge
crosses. A unit starts as one symbol for each UTF-8 byte, in a doubly linked list; a heap holds the adjacent pairs that
the vocabulary merges, by rank and then place. The lowest is popped and merged and its two new pairs pushed, until
none is left: the unit's count is its bytes less its merges. No token identifiers are emitted.

Counts of short units are remembered in each Python worker, in two generations of bounded size; a unit of n bytes
takes time n log n and about 100 n bytes of memory.

Defined results: a null or empty text has no token; a special string is one token wherever it stands, as the library
has it by default; repeated rows are each counted; a null doc_id stays; an empty table gives an empty result;
further columns are kept, and n_bytes and n_tokens take the place of columns of these names.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The pattern of units that byte-level vocabularies of this kind are made with (a fixed value).
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED, LONGEST_REMEMBERED = 400_000, 48
PLACES = 32  # bits of a place within a unit


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it can be seen, else one of those from 256 on, in order."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in seen else next(others)) for b in range(256)]


class Merges:
    """The pairs that a vocabulary merges: bytes' symbols, and rank and new symbol of a pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        kind = (model["type"], split.get("type"), split.get("add_prefix_space"), split.get("use_regex"), spec["normalizer"], model.get("dropout"), model.get("ignore_merges", False))
        if kind != ("BPE", "ByteLevel", False, True, None, None, False) or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        vocab, pairs = model["vocab"], [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.first = [vocab[c] for c in byte_symbols()]
        self.width = max(vocab.values()) + 1
        self.rank = {vocab[a] * self.width + vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.special = [t["content"] for t in spec["added_tokens"]]

    def count(self, unit: bytes) -> int:
        """Number of symbols left of a unit's bytes."""
        n = len(unit)
        if n < 2:
            return n
        rank, width, made, mask = self.rank, self.width, self.made, (1 << PLACES) - 1
        symbol = [self.first[b] for b in unit]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # n: none after; -1: none before
        heap = [r << PLACES | i for i in range(n - 1) if (r := rank.get(symbol[i] * width + symbol[i + 1])) is not None]
        heapify(heap)
        left = n
        while heap:
            r, i = divmod(heappop(heap), mask + 1)
            j = after[i]
            # a symbol merged away is -1; an entry whose pair has changed since has another rank
            if symbol[i] < 0 or j == n or rank.get(symbol[i] * width + symbol[j]) != r:
                continue
            symbol[i], symbol[j] = made[r], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank.get(symbol[i] * width + symbol[k])) is not None:
                    heappush(heap, s << PLACES | i)
            if (h := before[i]) >= 0 and (s := rank.get(symbol[h] * width + symbol[i])) is not None:
                heappush(heap, s << PLACES | h)
        return left


class TokenCounter:
    """Counts tokens of texts and remembers the counts of short units."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.units = regex.compile(UNITS).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True)))) if self.merges.special else None
        self.known: dict[str, int] = {}
        self.former: dict[str, int] = {}

    def _unit(self, unit: str) -> int:
        if len(unit) > LONGEST_REMEMBERED:
            return self.merges.count(unit.encode("utf-8", "surrogatepass"))
        n = self.known.get(unit)
        if n is None:
            n = self.former.get(unit)
            if n is None:
                n = self.merges.count(unit.encode("utf-8", "surrogatepass"))
            if len(self.known) >= REMEMBERED:
                self.former, self.known = self.known, {}
            self.known[unit] = n
        return n

    def __call__(self, text: str) -> int:
        parts, total = [text], 0
        if self.special is not None and any(s in text for s in self.merges.special):
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            units = self.units(part)
            try:
                total += sum(map(self.known.__getitem__, units))
            except KeyError:
                total += sum(map(self._unit, units))
        return total


@lru_cache(1)
def counter(path: str) -> TokenCounter:
    """The counter of this Python worker, kept from task to task."""
    return TokenCounter(path)


def token_count(tokenizer: str | None = None) -> Callable[[Column | str], Column]:
    """A function of a text column: its number of tokens; null has none.

    tokenizer: path of a byte-level BPE file of the tokenizers library that every executor can read; None takes
    byte_bpe_50k.json of the installed public_tokenizers.
    """

    def count(texts: pd.Series) -> pd.Series:
        import public_tokenizers

        tokens = counter(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        return pd.Series([tokens(t) for t in texts], dtype="int64")

    udf = F.pandas_udf(count, LongType())
    return lambda text: udf(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def count_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """docs with n_bytes of the UTF-8 text and n_tokens."""
    sized = docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    return sized.withColumn("n_tokens", token_count(tokenizer)("text"))
