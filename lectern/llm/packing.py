"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

tokenize_pieces turns each text into token ids, closes it with an end id and cuts only documents longer
than a sequence. pack_pieces deals the pieces (numbers only, never texts) by hash into groups of bounded
size and packs each group with the sum-of-squares rule: a piece goes where the sum, over all gaps, of
the squared number of open sequences having that gap becomes smallest. Sequences which a group could not
fill well are packed once more, several groups together, so that the number of badly filled sequences
does not grow with the number of groups.

Defined results: a null or empty text is one piece holding the end id alone; repeated rows are packed
each for itself; an empty table gives an empty result; further columns are ignored; null doc_id is kept.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable

#: White space as the tokenizer's own patterns know it; no token crosses it.
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: What a text may not hold to be split by LATIN: other scripts, the capital whose lower case depends on its place, special tokens.
RARE = re.compile(r"[^\x00-\u024f\u2010-\u2027\u2030-\u205e]|<\|")
#: The tokenizer's own split of lower-case text, for texts without RARE.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f0-9\xb2\xb3\xb9\xbc-\xbe]+")
CACHED_WORDS = 500_000


class WordEncoder:
    """Token ids of whole texts, four bytes little-endian each, through a bounded cache of the ids of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        plain = Tokenizer.from_file(path)  # for words that LATIN has split: lower case already, and whole
        plain.normalizer, plain.pre_tokenizer = None, ByteLevel(add_prefix_space=False, use_regex=False)
        self.encode_plain = plain.encode_batch_fast
        self.known: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def words(self, text: str) -> tuple[list[str], bool]:
        """The parts of text that are encoded each for itself; whether LATIN made them."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if RARE.search(text):
                return SPACE.split(text), False
        elif "<|" in text:
            return SPACE.split(text), False
        return LATIN.findall(text.lower()), True

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            (words, plain), known = self.words(text), self.known
            try:
                yield b"".join(map(known.__getitem__, words))
                continue
            except KeyError:
                pass
            if len(known) > CACHED_WORDS:
                self.former, self.known = known, {}
                known = self.known
            former = self.former
            missing = [w for w in dict.fromkeys(words) if w not in known]
            known.update((w, former[w]) for w in missing if w in former)
            if new := [w for w in missing if w not in former]:
                known.update((w, struct.pack(f"<{len(x.ids)}I", *x.ids)) for w, x in zip(new, (self.encode_plain if plain else self.encode)(new, add_special_tokens=False)))
            yield b"".join(map(known.__getitem__, words))


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task with the words it knows."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core already
    return WordEncoder(path)


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document.

    tokenizer: path of a tokenizers file that every executor can read; None takes word_bpe_49k.json of
    the installed public_tokenizers.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        encode = encoder(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
        end, step = np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], encode(batch["text"].tolist())):
                ids += end
                out += [(doc_id, i, i * capacity, len(part) // 4, zlib.crc32(part)) for i, part in enumerate(ids[a : a + step] for a in range(0, len(ids), step))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # pandas would turn a null id, and with it all ids, into floating point
    nulls = chosen.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "text")
    cut = nulls.mapInPandas(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return cut.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(-(2**63))))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first; the first of equally good gaps is the smallest."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    gaps = np.empty(0, np.int64)  # gaps that open bins have, ascending
    stale = True
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if stale:
            gaps = np.flatnonzero(count)
            stale = False
        fits = gaps[np.searchsorted(gaps, size) :]
        fresh = 2 * int(count[capacity - size]) + 1 if size < capacity else 0
        gap = capacity
        if len(fits):
            after = 2 * count[fits - size] + 1
            if fits[0] == size:
                after[0] = 0  # a full bin is not open
            change = after - 2 * count[fits] + 1
            best = int(np.argmin(change))
            if change[best] <= fresh:
                gap = int(fits[best])
        if gap == capacity:
            bin_, made = made, made + 1
        else:
            bin_ = waiting[gap].pop()
            count[gap] -= 1
            stale |= count[gap] == 0
        bins[i], offsets[i] = bin_, capacity - gap
        if left := gap - size:
            waiting[left].append(bin_)
            stale |= count[left] == 0
            count[left] += 1
    return bins, offsets


def _pack(numbers: DataFrame, group: str, capacity: int) -> DataFrame:
    """Adds bin, offset and used (what the bin holds) to each row of numbers, packed group by group."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = sum_of_squares(rows["length"].to_numpy(np.int64), capacity)
        used = np.bincount(bins, weights=rows["length"], minlength=1).astype(np.int64)
        return rows.assign(bin=bins, offset=offsets, used=used[bins])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbers.schema.fields)
    return numbers.groupBy(group).applyInPandas(one, f"{kinds}, bin long, offset long, used long")


def pack_pieces(pieces: DataFrame, capacity: int = 4096, group_size: int = 4096, again: int = 16) -> DataFrame:
    """pieces with sequence_id and offset: sequences hold capacity tokens at most, offsets are gapless from 0.

    group_size: pieces packed together, on average. again: so many groups hand the pieces of sequences
    with more than 1/64 of their room left to one second packing.
    """
    pieces = durable(pieces)
    groups = max(1, -(-pieces.count() // group_size))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(groups)).cast("int")
    keys = pieces.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("group", salt)
    first = durable(_pack(keys, "group", capacity))
    good = first.filter(F.col("used") >= capacity - capacity // 64).withColumn("sequence_id", F.col("group") * F.lit(2**32).cast("long") + F.col("bin"))
    rest = first.filter(F.col("used") < capacity - capacity // 64).drop("bin", "offset", "used").withColumn("group", (F.col("group") / again).cast("int"))
    second = _pack(rest, "group", capacity).withColumn("sequence_id", -1 - (F.col("group") * F.lit(2**32).cast("long") + F.col("bin")))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return good.select(names).unionByName(second.select(names)).withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(-(2**63))))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenizes docs and packs their pieces."""
    return pack_pieces(tokenize_pieces(docs, tokenizer, capacity, end_id), capacity)
