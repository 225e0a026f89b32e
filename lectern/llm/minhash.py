"""Links between documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

BANDS keys of ROWS minima each find the candidates: a pair at 0.8 shares a key with probability 0.998, a
more similar one with more. Pairs that meet are verified on the whole sets, so nothing below 0.8 is linked.
Documents that are in one component already are not compared. At each key, all are first compared with the
smallest one there. Documents that stand at keys where components still differ after that go through an exact
prefix filter: with shingles in ascending order of how many of these documents hold them, two sets that are
similar enough share one of their first few, which are their rarest. Only those that do are verified, so a
large group of documents that are alike, but not enough, makes no pairs of all its members.

Defined results: shingles are the XXH64 of words joined by a space, case ignored for ASCII; a text of fewer
words than a shingle is one shingle; null and empty texts have none and are not linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import durable, without
from lectern.llm.components import connected_components
from lectern.llm.simhash import fingerprint

BANDS, ROWS = 20, 6
#: Shingles whose permutations are made at a time.
BLOCK = 1 << 11


def shingles(text: str, size: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of the shingles of a text, sorted."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), np.uint64))


def _permutations() -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, odd: np.ndarray) -> list[int]:
    """The keys of a set of shingles, signed; none for an empty one."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    least = np.full(len(odd), np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (odd[:, None] * hashes[None, i : i + BLOCK]).min(1))
    keys = [xxh64_intdigest(rows.tobytes(), band) for band, rows in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, ids: list[str]) -> DataFrame:
    """ids, fp (the SimHash fingerprint), n (size of the set of shingles), keys (one for each band), in one pass over the texts."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        odd = _permutations()
        for texts in batches:
            sets = [shingles(t) for t in texts]
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pd.DataFrame({"fp": prints, "n": [len(s) for s in sets], "keys": [band_keys(s, odd) for s in sets]})

    made = F.pandas_udf(each, "fp long, n int, keys array<long>")(F.coalesce("text", F.lit("")))
    return docs.select(*ids, made.alias("m")).select(*ids, "m.fp", "m.n", "m.keys")


def _sets(docs: DataFrame) -> DataFrame:
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t).view(np.int64) for t in texts])

    return docs.select("id_", F.pandas_udf(each, "array<long>")(F.coalesce("text", F.lit(""))).alias("set"))


def _mixed(keyed: DataFrame, key: str = "key") -> DataFrame:
    """The rows of keys at which components differ."""
    at = W.partitionBy(key)
    return keyed.withColumns({"low_": F.min("root_").over(at), "high_": F.max("root_").over(at)}).filter("low_ <> high_").drop("low_", "high_")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b, the roots of pairs (x, y, a, b) whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("id_").alias("x"), F.col("set").alias("s")), "x").join(sets.select(F.col("id_").alias("y"), F.col("set").alias("t")), "y")
    shared = F.size(F.array_intersect("s", "t"))
    return both.filter(shared >= F.lit(least) * (F.size("s") + F.size("t") - shared)).select("a", "b").distinct()


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """x, y, a, b of all pairs of nodes (id_, root_, n) of different roots that may be similar enough.

    Sets of sizes n <= m share at least c = 2 least / (1 + least) n shingles, and least m, if they are. Whatever
    the order, one of the shared ones is among the first n - c + 1 of the smaller and m - least m + 1 of the larger.
    Similar sets share least / (1 + least) (n + m) or more, all but the first of them after the first one in both,
    so where that is, both sets must have as many left.
    """
    held = sets.join(nodes, "id_").select("id_", "root_", "n", F.explode("set").alias("shingle"))
    seen = held.groupBy("shingle").agg(F.count("*").alias("held_by"))
    place = F.row_number().over(W.partitionBy("id_").orderBy("held_by", "shingle"))
    first = lambda share: F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1
    placed = held.join(seen, "shingle").withColumn("place", place).filter(F.col("place") <= first(least)).filter("held_by > 1")
    kept = durable(_mixed(placed.withColumn("early", F.col("place") <= first(2 * least / (1 + least))).withColumn("left", F.col("n") - F.col("place") + 1).drop("place", "held_by"), "shingle"))
    x = kept.filter("early").select("shingle", F.col("id_").alias("x"), F.col("root_").alias("a"), F.col("n").alias("n_x"), F.col("left").alias("left_x"))
    y = kept.select("shingle", F.col("id_").alias("y"), F.col("root_").alias("b"), F.col("n").alias("n_y"), F.col("left").alias("left_y"))
    met = x.join(y, "shingle").filter("a <> b AND (n_x < n_y OR n_x = n_y AND x < y)").filter(F.col("n_x") >= F.lit(least) * F.col("n_y"))
    enough = F.least("left_x", "left_y") >= F.ceil(F.lit(least / (1 + least)) * (F.col("n_x") + F.col("n_y")) - 1e-9)
    return met.filter(enough).select("x", "y", "a", "b").distinct()


def similar_roots(keyed: DataFrame, docs: DataFrame, least: float = 0.8) -> DataFrame:
    """node, root of the components that similarity joins with others.

    keyed: id_ (unique), root_ (a number for each component), n and keys of each row, without texts; docs: id_, text.
    Only texts of rows that stand beside another component at a key are looked at again.
    """
    first = durable(_mixed(keyed.select("id_", "root_", "n", F.explode("keys").alias("key"))))
    sets = durable(_sets(without(docs.select("id_", "text"), first.select("id_").distinct(), "id_", "left_semi")))
    sized = lambda n, m: F.least(n, m) >= F.lit(least) * F.greatest(n, m)
    low = F.min(F.struct("root_", "id_", "n")).over(W.partitionBy("key"))
    stars = first.withColumn("low", low).filter("root_ <> low.root_").filter(sized(F.col("n"), F.col("low.n")))
    stars = stars.select(F.col("id_").alias("x"), F.col("low.id_").alias("y"), F.col("root_").alias("a"), F.col("low.root_").alias("b")).distinct()
    joined = durable(_verified(stars, sets, least))
    moved = durable(connected_components(joined))
    now = first.join(moved.withColumnsRenamed({"node": "root_", "root": "top_"}), "root_", "left").withColumn("root_", F.coalesce("top_", "root_")).drop("top_")
    rest = durable(_mixed(now).select("id_", "root_", "n").distinct())
    across = _prefix_pairs(rest, sets, least)
    return connected_components(joined.unionByName(moved.select(F.col("node").alias("a"), F.col("root").alias("b"))).unionByName(_verified(across, sets, least)))
