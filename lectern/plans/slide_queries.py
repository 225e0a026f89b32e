"""Queries of segments, slides and title cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import decoration as D
from lectern.operators import segments as S
from lectern.operators import slides as SL
from lectern.plans import adapters as A
from lectern.plans.adapters import with_views
from lectern.plans.catalog import query
from lectern.plans.text_queries import FILLER, HAN, MARK, jaccard_sql, signatures, signatures_sql, tidy_sql, tokens_lower_sql, tokens_sql, ui_sql


#: Paragraphs of segments, one recursive step a segment.
FOLDED = f"""k AS MATERIALIZED (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS n, start, "end", trim(text) AS text FROM segments WHERE NOT regexp_matches(trim(text), '{FILLER}')),
  r AS (
    SELECT video_id, n, 0 AS para_idx, start, "end", text, false AS closed FROM k WHERE n = 1
    UNION ALL
    SELECT k.video_id, k.n, CASE WHEN r.closed THEN r.para_idx + 1 ELSE r.para_idx END, CASE WHEN r.closed THEN k.start ELSE r.start END, k."end", CASE WHEN r.closed THEN k.text ELSE r.text || k.text END,
      NOT r.closed AND (k.start - r."end" > 0.9::DOUBLE OR length(r.text || k.text) >= 200 OR (length(r.text || k.text) >= 110 AND right(k.text, 1) IN ('。', '！', '？', '”')))
    FROM r JOIN k ON k.video_id = r.video_id AND k.n = r.n + 1
  ), last AS (SELECT *, row_number() OVER (PARTITION BY video_id, para_idx ORDER BY n DESC) AS back FROM r),
  folded AS MATERIALIZED (SELECT video_id, para_idx, start, "end", trim(text) AS text, {A._hms("start")} AS t FROM last WHERE back = 1)"""


@query("w1_to_paragraphs", with_views(["segments"], f", {FOLDED} SELECT * FROM folded", recursive=True))
def w1(spark: SparkSession, d: str) -> DataFrame:
    return S.to_paragraphs(A.segments(spark, d))


CHROME = f"""counts AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id),
  words AS (SELECT video_id, item, count(*) AS seen FROM (SELECT video_id, unnest({tokens_sql("text")}) AS item FROM frames) GROUP BY ALL),
  alone AS (SELECT video_id, item, count(*) AS seen FROM (SELECT video_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_full_match(w, '{HAN}'))) AS item FROM frames) GROUP BY ALL),
  runs AS (SELECT video_id, index, unnest(regexp_extract_all(text, '{HAN}+')) AS run FROM frames),
  pieces AS (SELECT DISTINCT video_id, index, substr(run, i, size) AS item FROM (SELECT *, unnest(range(1, length(run) - size + 2)) AS i FROM (SELECT *, unnest(range(2, 9)) AS size FROM runs) WHERE length(run) >= size)),
  grams AS (SELECT video_id, item, count(*) AS seen FROM pieces GROUP BY ALL),
  items AS (
    SELECT video_id, lower(item) AS item FROM words JOIN counts USING (video_id) WHERE seen >= n * 0.4 AND (length(item) > 1 OR item < chr(128))
    UNION SELECT video_id, item FROM grams JOIN counts USING (video_id) WHERE seen >= n * 0.6
    UNION SELECT video_id, item FROM alone JOIN counts USING (video_id) WHERE seen >= n * 0.3
    UNION SELECT video_id, unnest({fixed.CHROME_WORDS!r}) FROM counts
  ), chrome AS (SELECT video_id, list_sort(list(item)) AS chrome FROM items GROUP BY video_id)"""

PAGE = r"\b[0-9]{1,3}\s*/\s*[0-9]{1,3}\b"
CLEANED = rf"""{CHROME},
  s1 AS (SELECT f.*, chrome, regexp_replace(text, '{PAGE}', ' ', 'g') AS paged FROM frames f JOIN chrome USING (video_id)),
  s2 AS (SELECT *, list_aggregate(list_transform(regexp_extract_all(paged, '(?s){HAN}+|[A-Za-z][A-Za-z0-9_\-/.]*|[0-9]+|.'), lambda p:
      CASE WHEN regexp_matches(p, '^[A-Za-z0-9]') AND list_contains(chrome, lower(p)) THEN '' WHEN regexp_matches(p, '^{HAN}') AND list_contains(chrome, p) THEN ' ' ELSE p END), 'string_agg', '') AS runless FROM s1),
  s3 AS (SELECT *, list_transform(list_sort(list_transform(list_filter(chrome, lambda g: g > chr(128) AND length(g) >= 2), lambda g: {{'n': -length(g), 'g': g}})), lambda x: x.g) AS long FROM s2),
  s4 AS (SELECT *, list_reduce(list_concat([coalesce(runless, '')], long), lambda t, g: replace(t, g, ' ')) AS gramless FROM s3),
  s5 AS (SELECT *, list_aggregate(list_transform(regexp_extract_all(gramless, '\s+|\S+'), lambda w: CASE WHEN regexp_full_match(w, '{HAN}') AND list_contains(chrome, w) THEN ' ' ELSE w END), 'string_agg', '') AS apart FROM s4),
  s6 AS (SELECT *, trim(regexp_replace(regexp_replace(coalesce(apart, ''), '[&§@#]+', ' ', 'g'), '\s+', ' ', 'g')) AS done FROM s5),
  cleaned AS MATERIALIZED (SELECT video_id, index, file, t, text, chars, CASE WHEN len(regexp_extract_all(text, '{HAN}')) >= 8 AND len(regexp_extract_all(done, '{HAN}')) < len(regexp_extract_all(text, '{HAN}')) * 0.3 THEN trim(paged) ELSE done END AS clean FROM s6)"""


@query("a1_detect_chrome", with_views(["frames"], f", {CHROME} SELECT video_id, chrome FROM chrome"))
def a1(spark: SparkSession, d: str) -> DataFrame:
    return D.detect_chrome(A.frames(spark, d))


@query("f11_clean_slide", with_views(["frames"], f", {CLEANED} SELECT video_id, index, clean FROM cleaned"))
def f11(spark: SparkSession, d: str) -> DataFrame:
    return D.clean_frames(A.frames(spark, d)).select("video_id", "index", "clean")


ISLANDS = f"""tk AS (SELECT *, {tokens_sql("clean")} AS toks FROM cleaned),
  nw AS (SELECT *, CASE WHEN lag(index) OVER w IS NULL OR {jaccard_sql("lag(toks) OVER w", "toks")} < 0.5 THEN 1 ELSE 0 END AS new FROM tk WINDOW w AS (PARTITION BY video_id ORDER BY index)),
  isl AS (SELECT *, CAST(sum(new) OVER (PARTITION BY video_id ORDER BY index ROWS UNBOUNDED PRECEDING) - 1 AS INT) AS seg, row_number() OVER () AS rid FROM nw),
  best AS (SELECT *, first_value(clean) OVER (PARTITION BY video_id, seg ORDER BY length(clean) DESC, index) AS longest FROM isl)"""


@query("w2_slide_segments", with_views(["frames"], f", {CLEANED}, {ISLANDS} SELECT video_id, seg, min_by(t, index) AS t, any_value(trim(longest)) AS text, CAST(any_value(length(trim(longest))) AS INT) AS chars FROM best GROUP BY video_id, seg"))
def w2(spark: SparkSession, d: str) -> DataFrame:
    return SL.slide_segments(A.frames(spark, d))


@query(
    "w3_slide_intervals",
    with_views(
        ["frames"],
        f""", {CLEANED}, {ISLANDS}, iv AS (SELECT video_id, seg, min_by(t, index) AS t0, max_by(t, index) + 10 AS t1, min_by(file, index) AS file, any_value(trim(longest)) AS text, CAST(count(*) AS INT) AS frames FROM best GROUP BY video_id, seg)
    SELECT video_id, seg, t0, t1, file, text, {tidy_sql("text")} AS title, CAST(length(text) AS INT) AS chars, frames FROM iv""",
    ),
)
def w3(spark: SparkSession, d: str) -> DataFrame:
    return SL.slide_intervals(A.frames(spark, d))


@query(
    "w4_group_slides",
    with_views(
        ["frames"],
        f""", k AS MATERIALIZED (SELECT *, {tokens_lower_sql("text")} AS toks FROM frames),
    r AS (
      SELECT video_id, index, 0 AS seg, toks AS acc FROM k WHERE index = 0
      UNION ALL
      SELECT k.video_id, k.index, CASE WHEN same THEN r.seg ELSE r.seg + 1 END, CASE WHEN same THEN list_distinct(list_concat(r.acc, k.toks)) ELSE k.toks END
      FROM r JOIN k ON k.video_id = r.video_id AND k.index = r.index + 1,
        LATERAL (SELECT CASE WHEN len(r.acc) = 0 AND len(k.toks) = 0 THEN true ELSE {jaccard_sql("r.acc", "k.toks")} >= 0.5 END AS same) AS s
    ), g AS (SELECT r.video_id, r.seg, k.index, k.t, k.file, k.text, k.chars, row_number() OVER (PARTITION BY r.video_id, r.seg ORDER BY k.chars DESC, k.index) AS place,
        max(k.t) OVER p - min(k.t) OVER p + 10 AS span, count(*) OVER p AS n_frames FROM r JOIN k USING (video_id, index) WINDOW p AS (PARTITION BY r.video_id, r.seg))
    SELECT video_id, seg, t, file, text, CAST(chars AS INT) AS chars, round(span, 1) AS span, CAST(n_frames AS INT) AS n_frames FROM g WHERE place = 1 AND chars >= 20 AND span >= 5""",
        recursive=True,
    ),
)
def w4(spark: SparkSession, d: str) -> DataFrame:
    return SL.group_slides(A.frames(spark, d))


CARDS = f"""mk AS MATERIALIZED (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY seg) AS n, seg, t, text, chars FROM segs WHERE length(text) BETWEEN 4 AND 48 AND regexp_matches(text, '{MARK}')),
  rc AS (
    SELECT video_id, n, 0 AS card, seg, t, text, chars FROM mk WHERE n = 1
    UNION ALL
    SELECT mk.video_id, mk.n, CASE WHEN near THEN rc.card ELSE rc.card + 1 END, CASE WHEN keep THEN rc.seg ELSE mk.seg END, CASE WHEN keep THEN rc.t ELSE mk.t END, CASE WHEN keep THEN rc.text ELSE mk.text END, CASE WHEN keep THEN rc.chars ELSE mk.chars END
    FROM rc JOIN mk ON mk.video_id = rc.video_id AND mk.n = rc.n + 1, LATERAL (SELECT mk.t - rc.t < 30 AS near, mk.t - rc.t < 30 AND length(mk.text) <= length(rc.text) AS keep) AS s
  ), lc AS (SELECT *, row_number() OVER (PARTITION BY video_id, card ORDER BY n DESC) AS back FROM rc),
  cards AS MATERIALIZED (SELECT video_id, CAST(seg AS INT) AS seg, t, text, CAST(chars AS INT) AS chars FROM lc WHERE back = 1)"""


@query("w5_title_cards", with_views(["segs"], f", {CARDS} SELECT * FROM cards", recursive=True))
def w5(spark: SparkSession, d: str) -> DataFrame:
    return SL.pick_title_cards(A.segs(spark, d))


def picks_sql(candidates: str, img: str) -> str:
    """picks of candidates (cleaned frames with threshold and sig). Likeness to all earlier frames of a video is counted first, so that the recursion holds numbers only."""
    return rf"""qk AS MATERIALIZED (SELECT *, regexp_replace(clean, '[^\x{{4e00}}-\x{{9fff}}A-Za-z0-9]', '', 'g') AS kept FROM ({candidates}) WHERE length(clean) >= 8 AND NOT {ui_sql("clean")}),
  q0 AS (SELECT *, list_distinct(list_transform(range(1, length(kept) - 2), lambda i: substr(kept, i, 4))) AS grams FROM qk),
  q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY index) AS k FROM q0 WHERE len(grams) > 0),
  qg AS (SELECT video_id, k, unnest(grams) AS g FROM q),
  qc AS (SELECT a.video_id, a.k, b.k AS k0, count(*) AS both_ FROM qg a JOIN qg b ON b.video_id = a.video_id AND b.g = a.g AND b.k < a.k GROUP BY ALL),
  ql AS MATERIALIZED (SELECT a.video_id, a.k, list(CAST(coalesce(both_, 0) AS DOUBLE) / greatest(1, len(a.grams) + len(b.grams) - coalesce(both_, 0)) ORDER BY b.k) AS dups, list({img} ORDER BY b.k) AS imgs
    FROM q a JOIN q b ON b.video_id = a.video_id AND b.k < a.k LEFT JOIN qc ON qc.video_id = a.video_id AND qc.k = a.k AND qc.k0 = b.k GROUP BY a.video_id, a.k),
  qn AS MATERIALIZED (SELECT video_id, k, threshold, sig IS NULL AS blind, dups, imgs FROM q LEFT JOIN ql USING (video_id, k)),
  rr AS (
    SELECT video_id, k, true AS picked, 0.0::DOUBLE AS dup, 0.0::DOUBLE AS img, [k] AS recent FROM qn WHERE k = 1
    UNION ALL
    SELECT qn.video_id, qn.k, ok, d.dup, i.img, CASE WHEN ok THEN list_concat(rr.recent, [qn.k])[-4:] ELSE rr.recent END
    FROM rr JOIN qn ON qn.video_id = rr.video_id AND qn.k = rr.k + 1,
      LATERAL (SELECT list_max(list_transform(rr.recent, lambda x: qn.dups[x])) AS dup) AS d,
      LATERAL (SELECT CASE WHEN qn.blind THEN 0.0 ELSE greatest(0.0, coalesce(list_max(list_transform(rr.recent, lambda x: qn.imgs[x])), 0.0)) END AS img) AS i,
      LATERAL (SELECT d.dup <= 0.35 AND (qn.blind OR i.img <= qn.threshold) AS ok) AS o
  ), pk AS (SELECT q.*, dup, rr.img AS img FROM rr JOIN q USING (video_id, k) WHERE picked),
  picks AS MATERIALIZED (SELECT video_id, CAST(row_number() OVER w - 1 AS INT) AS pick, t AS t0, coalesce(lead(t) OVER w, t + 10) AS t1, file, clean AS text, {tidy_sql("clean")} AS title, CAST(length(clean) AS INT) AS chars, round(dup, 6) AS dup_to_prev, round(img, 4) AS img_dup
    FROM pk WINDOW w AS (PARTITION BY video_id ORDER BY index))"""


@query(
    "w6_select_representatives",
    with_views(
        ["frames"],
        f""", {CLEANED}, {signatures_sql()},
    th AS (SELECT video_id, greatest(near, 0.66::DOUBLE) AS threshold FROM (SELECT video_id, near, row_number() OVER (PARTITION BY video_id ORDER BY near, index) - 1 AS place, count(*) OVER (PARTITION BY video_id) AS m FROM n WHERE index > 0) WHERE place = m // 2),
    {picks_sql("SELECT cleaned.*, s.sig, coalesce(th.threshold, 0.66::DOUBLE) AS threshold FROM cleaned LEFT JOIN s USING (video_id, index) LEFT JOIN th USING (video_id)", "list_sum(list_transform(list_zip(a.sig, b.sig), lambda p: p[1] * p[2])) / len(a.sig)")}
    SELECT * FROM picks""",
        recursive=True,
    ),
)
def w6(spark: SparkSession, d: str) -> DataFrame:
    return representatives(spark, d, signatures(spark, d))


def representatives(spark: SparkSession, d: str, signatures: DataFrame | None = None) -> DataFrame:
    found = SL.representatives_of_videos(A.whole_frames(spark, d), signatures)
    return found.withColumns({"dup_to_prev": F.round("dup_to_prev", 6), "img_dup": F.round("img_dup", 4)})


#: picks without signatures.
TEXT_PICKS = picks_sql("SELECT *, NULL::DOUBLE[] AS sig, 0.66::DOUBLE AS threshold FROM cleaned", "0.0::DOUBLE")
