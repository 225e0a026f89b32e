"""Readers and writers of the files that a video's work leaves, one JSON array a video, or Parquet for large corpora."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "start double, end double, text string"
FRAMES = "index int, file string, t double, text string, chars int, dropped int"


def _video(part: int) -> Column:
    """The name of the folder that a file lies in, so many levels up."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -part)


def _arrays(spark: SparkSession, path: str, schema: str, place: str) -> DataFrame:
    """Rows of the files' arrays; a file that holds none, such as one cut short, fails the job and is named."""
    broken = F.raise_error(F.concat(F.lit("no JSON array: "), F.col("_metadata.file_path")))
    parsed = F.coalesce(F.from_json("value", f"array<struct<{schema}>>"), broken)
    rows = spark.read.text(path, wholetext=True).select(_video(2).alias("video_id"), parsed.alias("rows"))
    return rows.select("video_id", F.posexplode("rows").alias(place, "row")).select("video_id", place, "row.*")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """video_id, seq, start, end, text of <video>/asr_segments.json files; their order becomes seq."""
    return _arrays(spark, path, SEGMENTS, "seq")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """video_id, index, file, t, text, chars, dropped of <video>/frames_ocr.json files."""
    return _arrays(spark, path, FRAMES, "pos").drop("pos")


def term_rows(raw: DataFrame) -> DataFrame:
    """ord, term, replacement of raw (json): an object, an object under map, or a list of pairs; long terms first, else as given.

    A file's terms are one small list; ord is its place after sorting. Other columns of raw stay before them.
    """
    pairs = F.from_json("json", "array<array<string>>")
    under, plain = F.from_json("json", "struct<map:map<string,string>>")["map"], F.from_json("json", "map<string,string>")
    entries = F.when(F.ltrim("json").startswith("["), F.transform(pairs, lambda p: F.struct(p[0].alias("term"), p[1].alias("replacement")))).otherwise(
        F.transform(F.map_entries(F.when(under.isNotNull(), under).otherwise(plain)), lambda e: F.struct(e["key"].alias("term"), e["value"].alias("replacement")))
    )
    placed = F.transform(entries, lambda e, i: F.struct((-F.length(e["term"])).alias("n"), i.alias("i"), e["term"].alias("term"), e["replacement"].alias("replacement")))
    others = [c for c in raw.columns if c != "json"]
    rows = raw.select(*others, F.posexplode(F.array_sort(placed)).alias("ord", "e"))
    return rows.select(*others, "ord", "e.term", "e.replacement")


def load_term_map(spark: SparkSession, path: str | None) -> DataFrame:
    """term_rows of a file; no path, or one that does not exist, gives no terms."""
    none = spark.createDataFrame([], "ord int, term string, replacement string")
    if not path:
        return none
    try:
        found = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    return term_rows(found.withColumnRenamed("value", "json"))


def write_stage(df: DataFrame, path: str, buckets: int | None = None, form: str = "parquet") -> None:
    """Writes a stage's rows, dealt by video, so that later stages read a video from one place."""
    dealt = df.repartition(buckets, "video_id") if buckets else df.repartition("video_id")
    dealt.sortWithinPartitions("video_id").write.mode("overwrite").format(form).save(path)


def timed_lines(paras: DataFrame) -> DataFrame:
    """video_id, para_idx, line: [HH:MM:SS] text."""
    return paras.select("video_id", "para_idx", F.format_string("[%s] %s", "t", "text").alias("line"))


def write_timed_text(paras: DataFrame, path: str, buckets: int = 64) -> None:
    """Text files of timed lines, in folders of video buckets, a video's lines in order."""
    lines = timed_lines(paras).withColumn("video_bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)))
    ordered = lines.repartition("video_bucket").sortWithinPartitions("video_bucket", "video_id", "para_idx")
    ordered.select("video_bucket", "line").write.mode("overwrite").partitionBy("video_bucket").text(path)


def write_chapter_table(toc: DataFrame, path: str) -> None:
    """The chapters' table as CSV with a header."""
    toc.write.mode("overwrite").csv(path, header=True)
