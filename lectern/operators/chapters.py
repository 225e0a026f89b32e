"""Chapters of paragraphs, by the description's times, by title cards, or by duration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators.ordered import as_of, in_index_range
from lectern.sources.stages import keep


def parse_description(videos: DataFrame) -> DataFrame:
    """video_id, mark, t, title: the lines of description that begin with a time, numbered in line order."""
    lines = videos.select("video_id", F.posexplode(F.split(F.coalesce("description", F.lit("")), "\\R", -1)).alias("line", "raw"))
    shown = lines.withColumn("shown", F.regexp_replace(T.strip("raw"), "^[·\\-•* ]+", ""))
    part = lambda i: F.regexp_extract("shown", fixed.TIMED_LINE, i)
    marks = shown.withColumns({"time": part(1), "title": T.strip(part(2))}).filter((F.col("time") != "") & (F.col("title") != ""))
    seconds = F.aggregate(F.split("time", ":"), F.lit(0), lambda a, x: a * 60 + x.cast("int"))
    order = W.partitionBy("video_id").orderBy("line")
    return marks.select("video_id", (F.row_number().over(order) - 1).alias("mark"), seconds.cast("double").alias("t"), "title")


def _bounds(marks: DataFrame, paras: DataFrame, order: str) -> DataFrame:
    """marks with lo and hi: the first paragraph that ends at t or later, and the first that starts at the next mark or later."""
    until = marks.withColumn("until", F.lead("t").over(W.partitionBy("video_id").orderBy(order)))
    counts = paras.groupBy("video_id").agg(F.count("*").cast("int").alias("n"))
    p, first = paras.select("video_id", "para_idx", "start", "end"), F.min("other.para_idx")
    begun = as_of(until, p, ["video_id"], "t", "end", first, later=True).withColumnRenamed("found", "lo")
    both = as_of(begun, p, ["video_id"], "until", "start", first, later=True).withColumnRenamed("found", "hi")
    return both.join(counts, "video_id").withColumns({"lo": F.coalesce("lo", "n"), "hi": F.coalesce("hi", "n")})


def _numbered(chapters: DataFrame, order: str) -> DataFrame:
    ch = F.row_number().over(W.partitionBy("video_id").orderBy(order)).cast("int")
    return chapters.withColumn("ch", ch).select("video_id", "ch", "title", F.col("lo").cast("int").alias("from_idx"), F.col("hi").cast("int").alias("to_idx"), "auto")


def marks_to_ranges(marks: DataFrame, paras: DataFrame) -> DataFrame:
    """video_id, ch, title, from_idx, to_idx, auto: half-open ranges; a straddling paragraph may be in two."""
    found = _bounds(marks, paras, "mark").filter("hi > lo")
    return _numbered(found.withColumns({"title": T.tidy_title("title"), "auto": F.lit("description")}), "mark")


def chapters_from_slides(paras: DataFrame, cards: DataFrame) -> DataFrame:
    """Ranges between title cards that do not overlap, and an opening chapter before the first."""
    found = _bounds(cards, paras, "seg").withColumn("hi", F.greatest("hi", "lo"))
    before = W.partitionBy("video_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    cursor = F.coalesce(F.max("hi").over(before), F.lit(0))
    fitted = found.withColumn("cursor", cursor).withColumn("lo", F.greatest("lo", "cursor")).withColumn("hi", F.greatest("hi", "lo")).filter("hi > lo")
    titled = fitted.select("video_id", F.col("seg").cast("long").alias("at"), T.tidy_title("text").alias("title"), "lo", "hi")
    opening = titled.groupBy("video_id").agg(F.min_by("lo", "at").alias("hi")).filter("hi > 0").select("video_id", F.lit(-1).cast("long").alias("at"), F.lit(fixed.OPENING).alias("title"), F.lit(0).alias("lo"), "hi")
    return _numbered(opening.unionByName(titled).withColumn("auto", F.lit("slides")), "at")


def chapters_by_time(paras: DataFrame, titles: DataFrame | None = None, minutes: float = 8.0) -> DataFrame:
    """Equal numbers of paragraphs for each so many minutes; titled by the last marked title before, if titles (video_id, seg, t, text) has one."""
    sums = paras.groupBy("video_id").agg(F.count("*").alias("n"), (F.max_by("end", "para_idx") - F.min_by("start", "para_idx")).alias("span"))
    size = F.greatest(F.lit(1), F.floor(F.col("n") / F.greatest(F.lit(1), F.bround(F.col("span") / 60 / minutes, 0).cast("long"))))
    chunk = F.floor(F.col("para_idx") / F.col("size"))
    chunks = paras.join(sums.withColumn("size", size), "video_id").groupBy("video_id", chunk.cast("int").alias("k"))
    ranges = chunks.agg(F.min("para_idx").alias("lo"), (F.max("para_idx") + 1).alias("hi"), F.min_by("start", "para_idx").alias("start"))
    number = F.format_string(fixed.NUMBERED_CHAPTER, F.col("k") + 1)
    if titles is None:
        titled = ranges.withColumn("title", number)
    else:
        marked = titles.filter(T.is_title_mark("text")).select("video_id", "seg", "t", F.col("text").alias("said"))
        last = F.max_by("other.said", "other.seg")
        titled = as_of(ranges, marked, ["video_id"], "start", "t", last).withColumnRenamed("found", "said").withColumn("title", F.when(F.col("said").isNull(), number).otherwise(T.tidy_title("said")))
    return _numbered(titled.withColumn("auto", F.lit("time")), "k")


def choose_chapters(paras: DataFrame, videos: DataFrame, segs: DataFrame, cards: DataFrame, minutes: float = 8.0) -> DataFrame:
    """The first of three ways that works for a video: its description (3 marks or more, any chapter), title
    cards (3 chapters or more), or time; strategy says which, none for fewer than 3 chapters by description.

    Titles of chapters by time come from short slides, and only where no description was used.
    """
    marks = keep(parse_description(videos))
    many = marks.groupBy("video_id").agg(F.count("*").alias("m")).filter("m >= 3").select("video_id")
    ways = [
        marks_to_ranges(marks.join(many, "video_id", "left_semi"), paras).withColumn("rank", F.lit(1)),
        chapters_from_slides(paras, cards).withColumn("rank", F.lit(2)),
        chapters_by_time(paras, segs.filter(F.length("text") <= 48), minutes).withColumn("rank", F.lit(3)),
    ]
    every = ways[0].unionByName(ways[1]).unionByName(ways[2])
    n = every.withColumn("n", F.count("*").over(W.partitionBy("video_id", "rank"))).filter((F.col("rank") != 2) | (F.col("n") >= 3))
    best = n.withColumn("best", F.min("rank").over(W.partitionBy("video_id"))).filter("rank = best")
    strategy = F.when((F.col("rank") == 1) & (F.col("n") < 3), "none").otherwise(F.col("auto"))
    return best.select("video_id", "ch", "title", "from_idx", "to_idx", "auto", strategy.alias("strategy"))


def chapter_toc(chapters: DataFrame, paras: DataFrame) -> DataFrame:
    """video_id, ch, title, stamp, chars of each chapter: its first paragraph's time, - without one, and its length.

    Where chapters have a part, as those of a series, whose parts' times each begin at 0, its number stands before the time.
    """
    p = paras.select("video_id", "para_idx", "t", F.length("text").alias("n"))
    met = in_index_range(chapters.select("video_id", "ch", "from_idx", "to_idx"), p, "from_idx", "to_idx")
    sums = met.groupBy("video_id", "ch").agg(F.min_by("t", "para_idx").alias("first"), F.sum("n").alias("chars"))
    part = F.when(F.col("part") != 0, F.format_string("P%d ", "part")) if "part" in chapters.columns else F.lit(None).cast("string")
    every = chapters.select("video_id", "ch", "title", F.coalesce(part, F.lit("")).alias("part")).join(sums, ["video_id", "ch"], "left")
    return every.select("video_id", "ch", "title", F.coalesce(F.concat("part", "first"), F.lit("-")).alias("stamp"), F.coalesce("chars", F.lit(0).cast("long")).alias("chars"))
