"""Which steps are done for which video, so that a rerun does only the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(videos: DataFrame, ledger: DataFrame, step: str, outputs: DataFrame | None = None) -> DataFrame:
    """videos for which step is neither recorded nor has its output already (outputs: video_id)."""
    left = videos.join(ledger.filter(F.col("step") == step).select("video_id"), "video_id", "left_anti")
    return left.join(outputs.select("video_id"), "video_id", "left_anti") if outputs is not None else left


def mark(ledger: DataFrame, done: DataFrame, step: str) -> DataFrame:
    """ledger with step recorded once for each video of done."""
    return ledger.select("video_id", "step").union(done.select("video_id", F.lit(step).alias("step"))).dropDuplicates()
