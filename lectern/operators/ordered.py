"""Joins by order and by range within a video, in which work grows with the rows of both sides and not with their pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 64


def as_of(rows: DataFrame, others: DataFrame, keys: list[str], time: str, at: str, found: Column, later: bool = False, strict: bool = False) -> DataFrame:
    """rows with found, an aggregate of other (a struct of others' columns) over those of the same keys that have come by then.

    These are the others with at <= time, with later those with at >= time; strict leaves out equal ones. A row
    without a time meets none. One union, sorted once, takes the place of a join of all pairs.
    """
    # of equal times, others come first, or last where they are left out
    r = rows.select(*keys, F.col(time).alias("when"), F.lit(1).alias("side"), F.struct(*rows.columns).alias("row"))
    o = others.select(*keys, F.col(at).alias("when"), F.lit(2 if strict else 0).alias("side"), F.struct(*others.columns).alias("other"))
    when = F.col("when").desc_nulls_last() if later else F.col("when").asc_nulls_last()
    so_far = W.partitionBy(*keys).orderBy(when, "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = r.unionByName(o, allowMissingColumns=True).withColumn("found", found.over(so_far))
    return both.filter(F.col("row").isNotNull()).select("row.*", F.when(F.col("when").isNotNull(), F.col("found")).alias("found"))


def in_index_range(ranges: DataFrame, paras: DataFrame, lo: str, hi: str) -> DataFrame:
    """ranges (video_id and others) with each paragraph (para_idx and others) whose index is in lo to hi, hi left out.

    Met by blocks of indices, of which a range has none beyond the video's last paragraph.
    """
    block = lambda c: F.floor(c / BLOCK).cast("int")
    last = paras.groupBy("video_id").agg(F.max("para_idx").alias("last"))
    most = F.least(F.col(hi) - 1, "last")
    blocks = F.when(F.col(hi).isNotNull() & (most >= F.col(lo)), F.sequence(block(F.col(lo)), block(most)))
    p = paras.withColumn("block", block(F.col("para_idx")))
    met = ranges.join(last, "video_id").withColumn("block", F.explode(blocks)).drop("last").join(p, ["video_id", "block"])
    return met.filter((F.col("para_idx") >= F.col(lo)) & (F.col("para_idx") < F.col(hi))).drop("block")


def in_time_range(ranges: DataFrame, points: DataFrame, lo: str, hi: str, time: str, bin_seconds: float = 60.0) -> DataFrame:
    """ranges (video_id and others) with each point (time and others) from lo to hi, both ends included; met by bins of time.

    Bins are made only between a video's first and last point, so that a range without an end has no more of them.
    """
    bins = lambda c: F.floor(c / bin_seconds)
    ends = points.groupBy("video_id").agg(F.min(time).alias("first"), F.max(time).alias("last"))
    least, most = F.greatest(lo, "first"), F.least(hi, "last")
    over = F.when(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (least <= most), F.sequence(bins(least), bins(most)))
    r = ranges.join(ends, "video_id").withColumn("bin", F.explode(over)).drop("first", "last")
    met = r.join(points.withColumn("bin", bins(F.col(time))), ["video_id", "bin"])
    return met.filter(F.col(time).between(F.col(lo), F.col(hi))).drop("bin")
