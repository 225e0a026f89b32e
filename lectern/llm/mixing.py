"""Mixing of sources to target weights by weighted fair queueing, in DataFrame expressions only.

Each source's documents are shuffled by a hash. A document gets a virtual finish time, the words its source
has given up to and with it over the source's target, once for each of the three passes that a source may
take. All of them, of all sources, are put into one order of finish time, dealt out by range, and cut
where the words add up to the total budget.

Running sums never run over a whole source or table in one task: a source is dealt into buckets of its
shuffled order, of some thousand rows each, and the order of finish times into ranges; sums of buckets
and of ranges are added up first, and rows within them afterwards.

Defined results: a null text has size 0; null is a source of its own, last in order; a repeated row is a
document of its own; a document of size 0 takes no words; documents of equal places in the shuffled order
follow by doc_id, then size; a document longer than its source's target is taken at most as the budget
allows, texts of any length being counted whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import durable, word_count

#: Ranges of finish times; a bound, not a share of the data.
RANGES = 8192
PASSES = 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, docs, target of each source: words by weight, no target above PASSES times its size.

    Ascending by how far a source's limit is for its weight, sources stop at their limit as long as the
    share of what is left for them reaches it; the rest share what is left by weight. The table has one row a
    source, not a document, and is put in order in one task.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    all_weights = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sums.withColumn("weight", F.element_at(all_weights, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * float(PASSES)
    order = W.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    stops = level * F.col("weight") > limit
    # in this order the sources that stop come first; the level of the first that doesn't stop holds for all others
    levels = weighed.withColumn("level", F.when(~stops, level))
    free = F.first("level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return levels.withColumn("free", free).select("source", "source_size", "docs", F.when(F.col("level").isNull(), F.col("source_size") * float(PASSES)).otherwise(F.col("free") * F.col("weight")).alias("target"))


def _shuffled() -> Column:
    """Place in the shuffled order, the same in each run: 15 hexadecimal digits of a hash as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), bucket_rows: int = 2048, row: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row: in the mix it stands copies times.

    row: columns that tell rows apart, returned as well; ties of place and doc_id are then broken by them.
    """
    row = row or []
    sized = durable(docs.select("doc_id", "source", word_count("text").alias("size"), _shuffled().alias("place"), *row))
    sources = durable(source_targets(sized, weights))
    budget = F.sum("source_size").over(W.partitionBy()).alias("budget")
    buckets_of = F.greatest(F.lit(1), F.ceil(F.col("docs") / bucket_rows))
    bucket = F.floor(F.col("place") / F.lit(float(1 << 60)) * F.col("buckets")).cast("long")
    named = sources.select("source", "source_size", "target", buckets_of.alias("buckets"), budget).withColumn("same", F.xxhash64("source"))
    rows = sized.withColumn("same", F.xxhash64("source")).alias("r").join(named.alias("s"), F.expr("r.same = s.same AND r.source <=> s.source"))
    rows = rows.select("doc_id", "r.source", "size", "place", *row, "source_size", "target", "buckets", "budget").withColumn("bucket", bucket)
    # within a source: sums of buckets, then rows within a bucket
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("given"))
    at = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("given").over(at), F.lit(0)).alias("start"))
    key = F.xxhash64("source", "bucket")
    inner = W.partitionBy("source", "bucket").orderBy("place", "doc_id", "size", *row).rowsBetween(W.unboundedPreceding, W.currentRow)
    within = rows.withColumn("within", F.sum("size").over(inner)).withColumn("key", key)
    placed = within.alias("r").join(starts.withColumn("key", key).alias("s"), F.expr("r.key = s.key AND r.source <=> s.source AND r.bucket = s.bucket"))
    placed = durable(placed.select("doc_id", "r.source", "size", "place", *row, "source_size", "target", "budget", (F.col("start") + F.col("within")).alias("given")))
    passes = placed.filter("size > 0").withColumn("pass", F.explode(F.array(*[F.lit(k) for k in range(PASSES)])))
    finish = (F.col("pass") * F.col("source_size") + F.col("given")) / F.col("target")
    queued = passes.withColumn("finish", finish).withColumn("range", F.least(F.lit(RANGES - 1), F.floor(F.col("finish") * (RANGES // 2)).cast("long")))
    # over all: sums of ranges, then rows within a range
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = queued.groupBy("range").agg(F.sum("size").alias("sum")).withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    dealt = queued.join(F.broadcast(ranges.select("range", "start")), "range")
    line = W.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "place", "doc_id", "size", *row, "pass").rowsBetween(W.unboundedPreceding, W.currentRow)
    # a range that ends within the budget is taken whole, one that starts beyond it not at all
    reached = dealt.filter("start < budget").withColumn("reached", F.col("start") + F.sum("size").over(line))
    taken = reached.filter("reached <= budget").groupBy("doc_id", "source", "place", "given", "size", *row).agg(F.count("*").alias("copies"))
    same = F.expr(" AND ".join(["r.key = t.key AND r.doc_id <=> t.doc_id AND r.source <=> t.source AND r.given = t.given AND r.size = t.size", *[f"r.{c} = t.{c}" for c in row]]))
    key = F.xxhash64("doc_id", "source", "given", "size", *row)
    out = placed.withColumn("key", key).alias("r").join(taken.withColumn("key", key).alias("t"), same, "left")
    return out.select("r.doc_id", "r.source", "r.size", *[f"r.{c}" for c in row], "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"), (F.coalesce("copies", F.lit(0)) * F.col("r.size")).alias("taken"))
