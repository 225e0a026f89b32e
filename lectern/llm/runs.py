"""Stretches of words that repeat themselves at once: maximal periodic runs of texts, by descending-LCP Kruskal.

Suffixes of a text's words are put in order, with the length of the longest common prefix (LCP) of neighbours.
Neighbours are united from the longest LCP down: a union-find keeps for each class of suffixes its places in
ascending order, and the smaller class moves into the larger. Places i < j that become adjacent in a class at an
LCP of at least j - i seed a run of period j - i from i to j + LCP; it counts if the word before i is not the one
before j, as the run starts further left else. A run from s on with smallest period q has its seed at s and s + q:
a place between them in their class would give the run a smaller period. So each is found exactly once.

No LCP below the least that a wanted run can have is united, so only suffixes that share their first words (least of
them) with another suffix of the text are put in order. Time is n log n, memory some 200 bytes for each word of the
text at hand, as that is one value.

Defined results: words are runs of anything but the six ASCII white space characters; a null or empty text has none,
no runs, and an empty collapsed text; equal rows are each searched; doc_id may be null; an empty table gives an empty
result; further columns are left out. Ties of the best run: smallest start, then smallest period.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD

RUN = "struct<start:long,length:long,period:long>"
OUT_BYTES = 16 << 20


def least_lcp(min_length: int, min_exponent: int) -> int:
    """The smallest LCP that the seed of a wanted run can have, over all periods."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, max(1, min_length) + 1))


def repeated_blocks(words: list[bytes], size: int) -> bool:
    """Whether two places may start the same size words: compared by hashes, so never false if they do."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += h[k : len(h) - size + 1 + k]
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def suffix_order(ids: np.ndarray, least: int) -> np.ndarray:
    """Starts of suffixes in order, at least of all that share their first least words with another suffix.

    Sorted by one word, then by twice as many words each round, from the ranks of the round before; suffixes that are
    alone with their block of words have found their slot and take no further part.
    """
    n = len(ids)
    rank = np.full(2 * n + 1, -1, np.int64)  # by first slot of the group of equal blocks; -1 beyond the end
    rank[:n] = ids
    at, slots = np.arange(n), np.arange(n)
    ordered, size, shared = np.empty(n, np.int64), 0, None
    while len(at):
        key = rank[at] if size == 0 else rank[at] * (n + 1) + rank[at + size] + 1
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        ordered[slots] = at
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.diff(np.r_[first, len(at)])
        rank[at] = np.repeat(slots[first], many)
        size = max(1, 2 * size)
        stay = np.repeat(many > 1, many)
        at, slots = at[stay], slots[stay]
        if size <= least:
            shared = slots
    return ordered[shared]


def neighbour_lcp(ids: list[int], order: list[int], least: int) -> list[int]:
    """Words that each suffix of order shares with the one before it; 0 for the first. Linear in the text's length.

    A suffix that starts one word later shares one word less at least, as long as that are least words, which all
    suffixes of a group in order share.
    """
    before = dict(zip(order[1:], order))
    ended = [*ids, -1]
    at = dict.fromkeys(order, 0)
    last, h = -2, 0
    for i in sorted(before):
        j = before[i]
        h = h - 1 if i == last + 1 and h > least else 0
        while ended[i + h] == ended[j + h]:
            h += 1
        at[i], last = h, i
    return [at[i] for i in order]


def find_runs(words: list[bytes], min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """start, length, period of each maximal run of words with length >= max(min_length, min_exponent * period), by start, then period."""
    least = least_lcp(min_length, min_exponent)
    if len(words) < min_length or not repeated_blocks(words, least):
        return []
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = list(map(numbers.__getitem__, words))
    order = suffix_order(np.asarray(ids, np.int64), least).tolist()
    lcp = neighbour_lcp(ids, order, least)
    edges = np.asarray(lcp, np.int64)
    ranked = np.argsort(-edges, kind="stable")[: int((edges >= least).sum())].tolist()
    parent = list(range(len(order)))
    places: list[list[int] | None] = [[i] for i in order]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    runs = []

    def seed(i: int, j: int, shared: int) -> None:
        period = j - i
        if shared >= max(min_length - period, (min_exponent - 1) * period) and (i == 0 or ids[i - 1] != ids[j - 1]):
            runs.append((i, period + shared, period))

    for edge in ranked:
        shared, a, b = lcp[edge], find(edge - 1), find(edge)
        if len(places[a]) < len(places[b]):
            a, b = b, a
        parent[b], large, small = a, places[a], places[b]
        places[b] = None
        moved = -1
        for x, following in zip(small, [*small[1:], len(ids)]):
            k = bisect_left(large, x)
            # what moves just before or after x was next to it in its own class already
            if k and large[k - 1] != moved:
                seed(large[k - 1], x, shared)
            if k < len(large) and large[k] < following:
                seed(x, large[k], shared)
            large.insert(k, x)
            moved = x
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    inside = np.cumsum(change[:-1]) > 0
    return [w for w, gone in zip(words, inside.tolist()) if not gone]


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period), collapsed (words outside of repeats, joined by a space)."""
    if min_exponent < 2:
        raise ValueError("runs of an exponent below 2 are not found")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<{RUN}>, collapsed string"
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            begun, size, found, kept = 0, 0, [], []
            for i in range(len(ids)):
                # bytes.split() parts at the six ASCII white space characters, and at no others
                words = texts[i].as_py().encode("utf-8", "surrogatepass").split()
                runs = find_runs(words, min_length, min_exponent)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept.append(b" ".join(collapse(words, runs)))
                size += len(kept[-1])
                if size > OUT_BYTES or i + 1 == len(ids):
                    out = [ids.slice(begun, len(found)), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "runs", "collapsed"])
                    begun, size, found, kept = i + 1, 0, [], []

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(search, schema)


def best_run(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals; null without one."""
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda a, x: F.when(better(a, x), x).otherwise(a))


def repeat_words(text: Column, start: Callable[[Column], Column], period: Callable[[Column, Column], Column]) -> Column:
    """text's words, those from number start(n) on repeated with period(n, start), n being their number."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    sized = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), F.size(w).cast("long").alias("n")))
    placed = F.transform(sized, lambda x: F.struct(x["w"].alias("w"), start(x["n"]).alias("a"), x["n"].alias("n")))
    ready = F.transform(placed, lambda x: F.struct(x["w"].alias("w"), x["a"].alias("a"), period(x["n"], x["a"]).alias("p")))
    again = lambda x: F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["w"], (x["a"] + (i - x["a"]) % x["p"]).cast("int"))))
    return F.get(F.transform(ready, lambda x: F.array_join(again(x), " ")), F.lit(0))
