"""Slides and speech: what was said while a slide was shown, figures by chapter and paragraph."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators.fold import fold_by_key
from lectern.operators.ordered import as_of, in_index_range, in_time_range

#: Characters of a slide's text that a figure shows.
SHOWN = 160


def attach_speech(slides: DataFrame, segments: DataFrame, min_speech: int = 20, bin_seconds: float = 60.0) -> DataFrame:
    """slides with speech, speech_chars, speech_start: segments that overlap t0 to t1, in order, joined without a separator.

    Both sides are put into time bins, so that a video of many hours is many small joins.
    """
    bins = lambda lo, hi: F.sequence(F.floor(F.col(lo) / bin_seconds), F.greatest(F.floor(F.col(lo) / bin_seconds), F.floor(F.col(hi) / bin_seconds)))
    s = slides.select("video_id", "t0", "t1").distinct().withColumn("bin", F.explode(bins("t0", "t1")))
    g = segments.select("video_id", "seq", "start", "end", T.strip("text").alias("said")).withColumn("bin", F.explode(bins("start", "end")))
    met = s.join(g, ["video_id", "bin"]).filter((F.col("end") > F.col("t0")) & (F.col("start") < F.col("t1"))).drop("bin").dropDuplicates(["video_id", "t0", "t1", "seq"])
    spoken = met.groupBy("video_id", "t0", "t1").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "said")))["said"], "").alias("speech"))
    if min_speech > 0:
        every = slides.join(spoken.filter(F.length("speech") >= min_speech), ["video_id", "t0", "t1"])
    else:
        every = slides.join(spoken, ["video_id", "t0", "t1"], "left").withColumn("speech", F.coalesce("speech", F.lit("")))
    return every.withColumns({"speech_chars": F.length("speech"), "speech_start": F.col("t0")}).filter(F.col("speech_chars") >= min_speech)


def talking_head_gate(videos: DataFrame, slides: DataFrame, min_content_frames: int = 5) -> DataFrame:
    """video_id, content_frames, skip_reason: talking_head for videos with fewer slides, which get no figures."""
    counts = slides.groupBy("video_id").agg(F.count("*").alias("n"))
    every = videos.select("video_id").join(counts, "video_id", "left").withColumn("content_frames", F.coalesce("n", F.lit(0)).cast("long"))
    return every.select("video_id", "content_frames", F.when(F.col("content_frames") < min_content_frames, "talking_head").alias("skip_reason"))


def even_thin(rows: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """At most so many rows of each group, evenly spread in order."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1
    n = F.count("*").over(W.partitionBy(*group))
    kept = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("n_") / most)).cast("int"))
    return rows.withColumns({"place_": place, "n_": n}).filter((F.col("n_") <= most) | F.array_contains(kept, F.col("place_"))).drop("place_", "n_")


def chapter_times(chapters: DataFrame, paras: DataFrame) -> DataFrame:
    """chapters with lo, hi (hi cut at the number of paragraphs), t_lo and t_hi, start of the first and end of the last paragraph."""
    p = paras.select("video_id", "para_idx", "start", "end")
    counts = p.groupBy("video_id").agg(F.count("*").cast("int").alias("n"))
    bounded = chapters.join(counts, "video_id").withColumns({"lo": F.col("from_idx"), "hi": F.least("to_idx", "n")})
    starts = p.select("video_id", F.col("para_idx").alias("lo"), F.col("start").alias("t_lo"))
    ends = p.select("video_id", (F.col("para_idx") + 1).alias("hi"), F.col("end").alias("t_hi"))
    return bounded.join(starts, ["video_id", "lo"], "left").join(ends, ["video_id", "hi"], "left")


def figure_paragraphs(figures: DataFrame, paras: DataFrame, time: str) -> DataFrame:
    """figures with para_index: the last paragraph, counted from lo on while starts do not pass the time, else lo."""
    chapters = figures.select("video_id", "ch", "lo", "hi").distinct()
    told = in_index_range(chapters, paras.select("video_id", "para_idx", "start"), "lo", "hi").select("video_id", "ch", "para_idx", "start")
    stopped = as_of(figures, told, ["video_id", "ch"], time, "start", F.min("other.para_idx"), later=True, strict=True)
    index = F.greatest(F.coalesce(F.col("found"), F.col("hi")) - 1, F.col("lo"))
    return stopped.withColumn("para_index", index.cast("int")).drop("found")


class Unused:
    """Slides of one video that each chapter picks, in order of chapters, evenly thinned; a picked one is used up."""

    def __init__(self, video_id: Any, most: int):
        self.video_id, self.most, self.used, self.ch, self.inside = video_id, most, set(), None, []

    def step(self, row: dict[str, Any]) -> list[dict[str, Any]]:
        out = []
        if row["ch"] != self.ch:
            out = self.end()
            self.ch = row["ch"]
        if row["t0"] not in self.used:
            self.inside.append(row["t0"])
        return out

    def end(self) -> list[dict[str, Any]]:
        inside, n = self.inside, len(self.inside)
        if n > self.most:
            inside = [inside[int(i * (n / self.most))] for i in range(self.most)]
        self.used.update(inside)
        self.inside = []
        return [{"video_id": self.video_id, "ch": self.ch, "k": k, "t0": t} for k, t in enumerate(inside, 1)]


def to_figures(slides: DataFrame, chapters: DataFrame, paras: DataFrame, most: int = 8, min_title: int = 6, early: float = 5.0) -> DataFrame:
    """Figures of slides with speech: at most so many a chapter, each slide in one chapter only, before the paragraph that begins it."""
    times = chapter_times(chapters, paras).filter("lo < n").select("video_id", "ch", "lo", "hi", "t_lo", "t_hi")
    titled = slides.filter(F.length("title") >= min_title)
    from_early = times.withColumn("since", F.col("t_lo") - early)
    inside = in_time_range(from_early, titled.select("video_id", "t0"), "since", "t_hi", "t0").select("video_id", "ch", "t0")
    picked = fold_by_key(inside, "video_id", ["ch", "t0"], lambda v: Unused(v, most), "video_id string, ch int, k int, t0 double")
    placed = figure_paragraphs(picked.join(times, ["video_id", "ch"]), paras, "t0").join(titled, ["video_id", "t0"])
    t_str = T.hms("t0")
    return placed.select(
        "video_id",
        F.col("ch").alias("chapter"),
        "k",
        "para_index",
        F.lit("before").alias("pos"),
        "file",
        F.col("t0").alias("t"),
        "t1",
        t_str.alias("t_str"),
        "title",
        T.figure_caption("ch", "k", "title", t_str).alias("caption"),
        T.looks_like_ui_chrome("title").alias("caption_fallback"),
        F.bround(F.col("t1") - F.col("t0"), 1).alias("span"),
        "dup_to_prev",
        F.substring("text", 1, SHOWN).alias("ocr"),
        F.substring("speech", 1, 600).alias("speech"),
    )


def assign_to_chapters(slides: DataFrame, chapters: DataFrame, paras: DataFrame, most: int = 3) -> DataFrame:
    """Figures of slides (t, file, and text, if ocr is wanted) by chapter times alone; a video without chapters is one chapter."""
    counts = paras.groupBy("video_id").agg(F.count("*").cast("int").alias("n"))
    whole = counts.join(chapters, "video_id", "left_anti").select("video_id", F.lit(1).alias("ch"), F.lit(0).alias("from_idx"), F.col("n").alias("to_idx"))
    every = chapters.select("video_id", "ch", "from_idx", "to_idx").unionByName(whole)
    times = chapter_times(every, paras).select("video_id", "ch", "lo", "hi", F.coalesce("t_lo", F.lit(0.0)).alias("t_lo"), F.coalesce("t_hi", F.lit(1e9)).alias("t_hi"))
    # no more of a text moves than is shown
    ocr = [F.substring("text", 1, 120).alias("ocr")] if "text" in slides.columns else []
    inside = in_time_range(times, slides.select("video_id", "t", "file", *ocr), "t_lo", "t_hi", "t")
    thin = even_thin(inside, ["video_id", "ch"], ["t"], most)
    placed = figure_paragraphs(thin.withColumn("k", F.row_number().over(W.partitionBy("video_id", "ch").orderBy("t"))), paras, "t")
    t_str = T.hms("t")
    caption = F.format_string(fixed.TIMED_CAPTION, F.col("ch"), F.col("k"), t_str)
    return placed.select("video_id", F.col("ch").alias("chapter"), "k", "para_index", "file", "t", t_str.alias("t_str"), caption.alias("caption"), *(["ocr"] if ocr else []))


def figure_free(slides: DataFrame, gate: DataFrame) -> DataFrame:
    """slides of the videos that the gate lets have figures."""
    return slides.join(gate.filter("skip_reason IS NULL").select("video_id"), "video_id", "left_semi")
