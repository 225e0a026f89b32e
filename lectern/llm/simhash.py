"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Fingerprints link at 3 or fewer differing bits. The 64 bits are parted into three thirds; whichever bits
differ, leaving out a third that holds one of them leaves at most 2 differing bits in the kept ones. On
each of the three kept parts a fingerprint emits every variant within 1 bit, half of that radius, so
linked fingerprints meet at a variant between them. Equal fingerprints are one node from the start, so
groups of copies cost nothing; fingerprints that meet are deduplicated and verified on all 64 bits.

Linking all pairs that meet would grow with the square of a group's size; near_components says how
the links are kept few without losing any. What meets is deduplicated and verified on all 64 bits.

Defined results: a null or empty text has fingerprint zero, which links like any other; repeated rows
are returned each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import durable
from lectern.llm.components import connected_components

BITS, RADIUS, THIRDS = 64, 3, ((0, 21), (21, 42), (42, 64))
#: Hashes that are unpacked to bits at a time.
BLOCK = 1 << 14


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The 64 majority bits over the XXH64 of all shingles of a text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    shingles = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else iter([words])
    hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(seed)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        part = hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint, a signed 64-bit number, of each row."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    make = F.pandas_udf(each, "long")
    return docs.select("doc_id", make(F.coalesce("text", F.lit(""))).alias("fp"))


def _mask(low: int, high: int) -> int:
    """All bits but low to high, as a signed number."""
    return -1 ^ (((1 << (high - low)) - 1) << low if high < BITS else -(1 << low))


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def _variants_of_part(part: int) -> F.Column:
    low, high = THIRDS[part]
    kept = F.col("fp").bitwiseAND(F.lit(_mask(low, high)))
    flips = F.array(*[F.lit(b).cast("long") for b in [0] + [_bit(i) for i in range(BITS) if not low <= i < high]])
    return F.transform(flips, lambda b: F.struct(F.lit(part).cast("byte").alias("part"), kept.bitwiseXOR(b).alias("key")))


def _variants() -> F.Column:
    """part and key of each variant within 1 bit of the kept bits, three parts."""
    return F.concat(*map(_variants_of_part, range(len(THIRDS))))


def _dropped() -> F.Column:
    """The third of fp that the variant's part leaves out."""
    masks = F.array(*[F.lit(_mask(*third)) for third in THIRDS])
    return F.col("fp").bitwiseAND(F.bitwise_not(F.element_at(masks, F.col("part") + 1)))


def near_components(nodes: DataFrame, crowd: int = 48) -> DataFrame:
    """fp, root for each fingerprint fp of nodes (distinct) that has a link; equal roots: reachable over links.

    First those are joined that meet at a variant and agree in the left-out third: they differ in at most 2
    bits, so each needs a link to the smallest one there only. What still meets across two components is
    verified pair by pair, or, where more than crowd fingerprints meet, linked as _crowd_links says.
    """
    variants = nodes.select("fp", F.explode(_variants()).alias("v")).select("fp", "v.part", "v.key")
    at = W.partitionBy("part", "key")
    met = durable(variants.withColumn("n", F.count("*").over(at)).filter("n > 1").drop("n"))
    stars = met.withColumn("low", F.min("fp").over(W.partitionBy("part", "key", _dropped()))).filter("fp <> low")
    first = durable(connected_components(stars.select(F.col("fp").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("fp"), "root"))
    named = met.join(first, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = durable(
        named.withColumns({"n": F.count("*").over(at), "low": F.min("root").over(at), "high": F.max("root").over(at)})
        .filter("low <> high")
        .drop("low", "high")
    )
    few = mixed.filter(F.col("n") <= crowd).groupBy("part", "key").agg(F.collect_list(F.struct("fp", "root")).alias("met"))
    pairs = (
        few.select("met", F.posexplode("met").alias("i", "x"))
        .select("x", F.explode(F.expr("filter(slice(met, i + 2, size(met)), y -> y.root <> x.root AND bit_count(y.fp ^ x.fp) <= 3)")).alias("y"))
        .select(F.col("x.root").alias("a"), F.col("y.root").alias("b"))
    )
    crowded = _crowd_links(mixed.filter(F.col("n") > crowd).select("fp", "root").distinct())
    second = connected_components(pairs.unionByName(crowded)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    ends = first.unionByName(second.select(F.col("root").alias("fp"), "root")).distinct()
    return ends.join(second, "root", "left").select("fp", F.coalesce("top", "root").alias("root")).distinct()


def _crowd_links(crowded: DataFrame) -> DataFrame:
    """Links between roots over any fp, root of crowded: each to the smallest root at each half-way value.

    A half-way value leaves one bit out and flips at most one other; fingerprints that share one differ in
    at most 3 bits, and any that differ in at most 3 bits share one.
    """
    bits = F.array(*[F.lit(_bit(i)).cast("long") for i in range(BITS)])
    holes = crowded.select("fp", "root", F.posexplode(bits).alias("out", "hole"))
    near = F.transform(bits, lambda b: F.col("fp").bitwiseXOR(b).bitwiseAND(F.bitwise_not(F.col("hole"))))
    values = holes.select("root", "out", F.explode(near).alias("key"))
    low = F.min("root").over(W.partitionBy("out", "key"))
    return values.withColumn("low", low).filter("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links) of each row of docs."""
    return grouped(durable(fingerprints(docs, shingle, seed)))


def grouped(prints: DataFrame) -> DataFrame:
    """component_id (smallest doc_id reachable over links) beside each row of prints (doc_id, fp, others), a table."""
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = durable(near_components(nodes.select("fp")))
    least = roots.join(nodes, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    every = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # on two keys, both sides are dealt anew, and Spark can split the rows of a fingerprint with many copies
    low = F.col("fp").bitwiseAND(0xFFFF)
    return prints.withColumn("low", low).join(every.withColumn("low", low), ["low", "fp"]).select(*prints.columns, "component_id")
