"""Series of videos: metadata, parts, and their merge into one book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T

META = """id string, title string, uploader string, channel string, duration double, webpage_url string, description string,
 license string, chapters array<struct<title:string,start_time:double,end_time:double>>,
 entries array<struct<playlist_index:int,title:string,duration:double,url:string,webpage_url:string>>,
 data struct<pages:array<struct<page:int,part:string,duration:double,cid:bigint>>>"""


def normalize_metadata(raw: DataFrame) -> DataFrame:
    """Slim metadata of raw (video_id, json): uploader or channel, empty texts for missing ones, entries as parts."""
    m = raw.select("video_id", F.from_json("json", META).alias("m")).select("video_id", "m.*")
    parts = F.transform("entries", lambda e: F.struct(e["playlist_index"].alias("index"), e["title"].alias("title"), e["duration"].alias("duration"), e["url"].alias("url")))
    named = lambda c: F.coalesce(c, F.lit(""))
    return m.select(
        "video_id",
        "id",
        "title",
        F.coalesce(F.nullif("uploader", F.lit("")), "channel").alias("uploader"),
        "duration",
        "webpage_url",
        named("description").alias("description"),
        named("license").alias("license"),
        F.coalesce("chapters", F.from_json(F.lit("[]"), "array<struct<title:string,start_time:double,end_time:double>>")).alias("chapters"),
        F.coalesce(parts, F.from_json(F.lit("[]"), "array<struct<index:int,title:string,duration:double,url:string>>")).alias("parts"),
    )


def list_parts(raw: DataFrame) -> DataFrame:
    """series_id, pos, index, title, duration, cid, url of the parts in raw (series_id, url, json), pages first, else entries."""
    m = raw.select("series_id", "url", F.from_json("json", META).alias("m"))
    base = F.substring_index("url", "?", 1)
    pages = F.transform(
        "m.data.pages",
        lambda p: F.struct(p["page"].alias("index"), F.coalesce(p["part"], F.lit("")).alias("title"), p["duration"].alias("duration"), p["cid"].alias("cid"), F.concat(base, F.lit("?p="), p["page"].cast("string")).alias("url")),
    )
    link = lambda e: F.coalesce(F.nullif(e["url"], F.lit("")), F.nullif(e["webpage_url"], F.lit("")), F.col("url"))
    entries = F.transform(
        "m.entries",
        lambda e, i: F.struct(F.coalesce(F.nullif(e["playlist_index"], F.lit(0)), i + 1).alias("index"), F.coalesce(e["title"], F.lit("")).alias("title"), e["duration"].alias("duration"), F.lit(None).cast("bigint").alias("cid"), link(e).alias("url")),
    )
    chosen = F.when(F.size(F.col("m.data.pages")) > 0, pages).otherwise(entries)
    return m.select("series_id", F.posexplode(chosen).alias("pos", "p")).select("series_id", "pos", "p.*")


def select_parts(parts: DataFrame, wanted: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """parts with dir and chapter_title: the wanted indexes (a DataFrame of index), else the first limit, else all, numbered in order."""
    place = F.row_number().over(W.partitionBy("series_id").orderBy("pos"))
    if wanted is not None:
        chosen = parts.join(wanted.select("index").distinct(), "index", "left_semi")
    else:
        chosen = parts.withColumn("place_", place).filter(F.col("place_") <= limit).drop("place_") if limit else parts
    numbered = chosen.withColumn("part", place)
    return numbered.withColumns({"dir": F.format_string("part-%03d", "part"), "chapter_title": T.clean_part_title("title")})


def part_bases(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """parts with n, the paragraphs of each (counts: series_id, part, n; 0 without any), and base, how many are in the parts before."""
    before = W.partitionBy("series_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sized = parts.join(counts, ["series_id", "part"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return sized.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int"))


def part_chapters(based: DataFrame) -> DataFrame:
    """Chapters of each series, one a part, of part_bases."""
    return based.select("series_id", F.col("part").alias("ch"), F.col("chapter_title").alias("title"), F.col("base").alias("from_idx"), (F.col("base") + F.col("n")).cast("int").alias("to_idx"), F.col("index").alias("part"), "duration")


def merge_paragraphs(parts: DataFrame, paras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paragraphs of each series with global index, part and part_index, and its chapters, one a part.

    parts: series_id, part, index, chapter_title, duration; paras: series_id, part, para_idx and more. Only
    counts of parts are put in order; paragraphs get their part's base by a join.
    """
    based = part_bases(parts, paras.groupBy("series_id", "part").agg(F.count("*").alias("n")))
    moved = paras.join(based.select("series_id", "part", F.col("index").alias("part_index"), "base"), ["series_id", "part"])
    merged = moved.withColumn("para_idx", (F.col("base") + F.col("para_idx")).cast("int")).drop("base")
    return merged, part_chapters(based)


def merge_figures(parts: DataFrame, chapters: DataFrame, figures: DataFrame) -> DataFrame:
    """figures (series_id, part, para_index, file, …) with global para_index, chapter and rel, the path from the series' folder."""
    base = chapters.select("series_id", F.col("ch").alias("part"), F.col("from_idx").alias("base"))
    named = figures.join(base, ["series_id", "part"]).join(parts.select("series_id", "part", "dir"), ["series_id", "part"])
    return named.withColumns({"para_index": (F.col("base") + F.col("para_index")).cast("int"), "chapter": F.col("part"), "rel": F.concat("dir", F.lit("/frames/"), "file")}).drop("base", "dir")


def series_summary(parts: DataFrame, total: DataFrame) -> DataFrame:
    """series_id, title, subtitle, selected, total_parts, minutes. total: series_id, total_parts."""
    sums = parts.groupBy("series_id").agg(F.min_by("title", "part").alias("first"), F.count("*").alias("selected"), (F.coalesce(F.sum("duration"), F.lit(0.0)) / 60).alias("minutes"))
    title = F.regexp_replace(F.coalesce("first", F.lit("")), "^[^\\p{L}\\p{N}_]+", "")
    joined = sums.join(total, "series_id")
    subtitle = F.format_string(fixed.SERIES_SUBTITLE, "selected", "total_parts", F.bround("minutes", 0).cast("long"))
    return joined.select("series_id", F.when(title == "", fixed.SERIES_TITLE).otherwise(title).alias("title"), subtitle.alias("subtitle"), "selected", "total_parts", "minutes")
