"""Queries of chapters, and the flagship from transcript to contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chapters as C
from lectern.operators import segments as S
from lectern.operators import slides as SL
from lectern.plans import adapters as A
from lectern.plans.adapters import with_views
from lectern.plans.catalog import query
from lectern.plans.slide_queries import CARDS, FOLDED
from lectern.plans.text_queries import MARK, tidy_sql
from lectern.sources.stages import keep

TIMED = r"^\s*[(\[]?((?:[0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2})[)\]]?\s*[-–—:：]?\s*(.+?)\s*$"

MARKS = rf"""dl AS (SELECT video_id, unnest(range(len(l))) AS line, regexp_replace(trim(unnest(l)), '^[·\-•* ]+', '') AS shown FROM (SELECT video_id, string_split(description, chr(10)) AS l FROM videos)),
  dm AS (SELECT video_id, line, string_split(regexp_extract(shown, '{TIMED}', 1), ':') AS hms, trim(regexp_extract(shown, '{TIMED}', 2)) AS title FROM dl WHERE regexp_matches(shown, '{TIMED}')),
  marks AS MATERIALIZED (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY line) - 1 AS mark, CAST(CASE WHEN len(hms) = 3 THEN CAST(hms[1] AS INT) * 3600 + CAST(hms[2] AS INT) * 60 + CAST(hms[3] AS INT) ELSE CAST(hms[1] AS INT) * 60 + CAST(hms[2] AS INT) END AS DOUBLE) AS t, title FROM dm WHERE title <> '')"""


def bounds(name: str, marks: str, order: str) -> str:
    return f"""{name}_u AS (SELECT *, lead(t) OVER (PARTITION BY video_id ORDER BY {order}) AS until FROM {marks}),
  {name} AS MATERIALIZED (SELECT m.*, n, coalesce((SELECT min(para_idx) FROM paras p WHERE p.video_id = m.video_id AND p."end" >= m.t), n) AS lo, coalesce((SELECT min(para_idx) FROM paras p WHERE p.video_id = m.video_id AND p.start >= m.until), n) AS hi
    FROM {name}_u m JOIN (SELECT video_id, count(*) AS n FROM paras GROUP BY video_id) USING (video_id))"""


BY_MARKS = f"""{bounds("mb", "marks", "mark")},
  by_marks AS MATERIALIZED (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY mark) AS INT) AS ch, {tidy_sql("title")} AS title, CAST(lo AS INT) AS from_idx, CAST(hi AS INT) AS to_idx, 'description' AS auto FROM mb WHERE hi > lo)"""

BY_CARDS = f"""{bounds("cb", "cards", "seg")},
  cb1 AS (SELECT *, greatest(hi, lo) AS hi1 FROM cb),
  cb2 AS (SELECT *, greatest(lo, coalesce(max(hi1) OVER (PARTITION BY video_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lo2 FROM cb1),
  cb3 AS (SELECT video_id, seg AS place, {tidy_sql("text")} AS title, lo2 AS lo, greatest(hi1, lo2) AS hi FROM cb2 WHERE greatest(hi1, lo2) > lo2),
  cb4 AS (SELECT * FROM cb3 UNION ALL SELECT video_id, -1, '开篇', 0, min_by(lo, place) FROM cb3 GROUP BY video_id HAVING min_by(lo, place) > 0),
  by_cards AS MATERIALIZED (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY place) AS INT) AS ch, title, CAST(lo AS INT) AS from_idx, CAST(hi AS INT) AS to_idx, 'slides' AS auto FROM cb4)"""


def by_time(titles: str | None) -> str:
    said = f"(SELECT max_by(text, seg) FROM {titles} s WHERE s.video_id = r.video_id AND s.t <= r.start AND length(text) <= 48 AND regexp_matches(text, '{MARK}'))" if titles else "NULL"
    return f"""ts AS (SELECT video_id, count(*) AS n, max_by("end", para_idx) - min_by(start, para_idx) AS span FROM paras GROUP BY video_id),
  tz AS (SELECT video_id, greatest(1, n // greatest(1, CAST(round_even(span / 60 / 0.5::DOUBLE, 0) AS BIGINT))) AS size FROM ts),
  tr AS (SELECT video_id, para_idx // size AS k, min(para_idx) AS lo, max(para_idx) + 1 AS hi, min_by(start, para_idx) AS start FROM paras JOIN tz USING (video_id) GROUP BY ALL),
  tq AS (SELECT *, {said} AS said FROM tr r),
  by_time AS MATERIALIZED (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY k) AS INT) AS ch, CASE WHEN said IS NULL THEN printf('第%d章', k + 1) ELSE {tidy_sql("said")} END AS title, CAST(lo AS INT) AS from_idx, CAST(hi AS INT) AS to_idx, 'time' AS auto FROM tq)"""


@query("f15_parse_description", with_views(["videos"], f", {MARKS} SELECT * FROM marks"))
def f15(spark: SparkSession, d: str) -> DataFrame:
    return C.parse_description(A.videos(spark, d))


@query("j2_marks_to_ranges", with_views(["videos", "paras"], f", {MARKS}, {BY_MARKS} SELECT * FROM by_marks"))
def j2(spark: SparkSession, d: str) -> DataFrame:
    return C.marks_to_ranges(C.parse_description(A.videos(spark, d)), A.paragraphs(spark, d))


@query("j3_chapters_from_slides", with_views(["segs", "paras"], f", {CARDS}, {BY_CARDS} SELECT * FROM by_cards", recursive=True))
def j3(spark: SparkSession, d: str) -> DataFrame:
    return C.chapters_from_slides(A.paragraphs(spark, d), SL.pick_title_cards(A.segs(spark, d)))


@query("w7_chapters_by_time", with_views(["paras"], f", {by_time(None)} SELECT * FROM by_time"))
def w7(spark: SparkSession, d: str) -> DataFrame:
    return C.chapters_by_time(A.paragraphs(spark, d), minutes=0.5)


@query("j4_titles_before", with_views(["paras", "segs"], f", {by_time('segs')} SELECT * FROM by_time"))
def j4(spark: SparkSession, d: str) -> DataFrame:
    return C.chapters_by_time(A.paragraphs(spark, d), A.segs(spark, d).filter(F.length("text") <= 48), minutes=0.5)


CHOSEN = f"""{MARKS}, {BY_MARKS}, {CARDS}, {BY_CARDS}, {by_time("segs")},
  ways AS (SELECT *, 1 AS rank FROM by_marks WHERE video_id IN (SELECT video_id FROM marks GROUP BY video_id HAVING count(*) >= 3)
    UNION ALL SELECT *, 2 FROM by_cards UNION ALL SELECT *, 3 FROM by_time),
  wn AS (SELECT *, count(*) OVER (PARTITION BY video_id, rank) AS n FROM ways),
  wb AS (SELECT *, min(rank) OVER (PARTITION BY video_id) AS best FROM wn WHERE rank <> 2 OR n >= 3),
  chosen AS MATERIALIZED (SELECT video_id, ch, title, from_idx, to_idx, auto, CASE WHEN rank = 1 AND n < 3 THEN 'none' ELSE auto END AS strategy FROM wb WHERE rank = best)"""


def chosen(spark: SparkSession, d: str) -> DataFrame:
    # kept, as they are read many times; of slides, what may be a title card or title
    s, paras = keep(SL.title_marked(A.segs(spark, d))), keep(A.paragraphs(spark, d))
    return C.choose_chapters(paras, A.videos(spark, d), s, SL.pick_title_cards(s), minutes=0.5)


@query("u5_choose_chapters", with_views(["videos", "paras", "segs"], f", {CHOSEN} SELECT * FROM chosen", recursive=True))
def u5(spark: SparkSession, d: str) -> DataFrame:
    return chosen(spark, d)


TOC = """toc AS (SELECT c.video_id, c.ch, c.title, coalesce(min_by(p.t, p.para_idx), '-') AS stamp, CAST(coalesce(sum(length(p.text)), 0) AS BIGINT) AS chars
  FROM chapters c LEFT JOIN paras p ON p.video_id = c.video_id AND p.para_idx >= c.from_idx AND p.para_idx < c.to_idx GROUP BY c.video_id, c.ch, c.title)"""


@query("a3_s8_chapter_toc", with_views(["videos", "paras"], f", {MARKS}, {BY_MARKS}, chapters AS (SELECT * FROM by_marks), {TOC} SELECT * FROM toc"))
def a3(spark: SparkSession, d: str) -> DataFrame:
    paras = A.paragraphs(spark, d)
    return C.chapter_toc(C.marks_to_ranges(C.parse_description(A.videos(spark, d)), paras), paras)


@query(
    "wa_transcript_to_toc",
    with_views(["paras"], f", {by_time(None)}, chapters AS (SELECT * FROM by_time), {TOC} SELECT * FROM toc"),
)
def wa(spark: SparkSession, d: str) -> DataFrame:
    paras = A.paragraphs(spark, d)
    return C.chapter_toc(C.chapters_by_time(paras, minutes=0.5), paras)


@query("wa_speech_to_toc", with_views(["segments"], f", {FOLDED}, paras AS MATERIALIZED (SELECT * FROM folded), {by_time(None)}, chapters AS (SELECT * FROM by_time), {TOC} SELECT * FROM toc", recursive=True))
def wa_speech(spark: SparkSession, d: str) -> DataFrame:
    """From segments by the fold to paragraphs, their chapters by time and contents."""
    paras = S.to_paragraphs(A.segments(spark, d))
    return C.chapter_toc(C.chapters_by_time(paras, minutes=0.5), paras)
