"""Queries of the expressions on text, and of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators import segments as S
from lectern.operators import series as SE
from lectern.operators import slides as SL
from lectern.plans import adapters as A
from lectern.plans.adapters import with_views
from lectern.plans.catalog import query
from lectern.sources import files as FI

HAN = r"[\x{4e00}-\x{9fff}]"
SPACE = r"[\s\x{a0}\x{3000}]"
FILLER = fixed.FILLER_PATTERN.replace("\\s", r"\s")
MARK = r"(?i)(GEN\s*[0-9]|第\s*[一二三四五六七八九十0-9]+\s*[章代]|^[0-9]{1,2}\s|[·｜|]|规律\s*[0-9]|结论|终论|前瞻|小结|总结)"
START = r"(?:GEN\s*[0-9]|规律\s*[0-9]|第\s*[一二三四五六七八九十0-9]+\s*[章代])"


def tokens_sql(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({x}, '{HAN}|[A-Za-z][A-Za-z0-9_\-]*'))"


def tokens_lower_sql(x: str) -> str:
    return rf"list_distinct(list_concat(regexp_extract_all({x}, '{HAN}'), list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9_\-]+'), lambda w: lower(w))))"


def jaccard_sql(a: str, b: str) -> str:
    return f"CAST(len(list_intersect({a}, {b})) AS DOUBLE) / greatest(1, len(list_distinct(list_concat({a}, {b}))))"


def ngrams_sql(x: str, n: int = 4) -> str:
    kept = rf"regexp_replace(coalesce({x}, ''), '[^\x{{4e00}}-\x{{9fff}}A-Za-z0-9]', '', 'g')"
    return f"list_distinct(list_transform(range(1, length({kept}) - {n} + 2), lambda i: substr({kept}, i, {n})))"


def trim_set(x: str, signs: str) -> str:
    return rf"regexp_replace({x}, '^[{signs}]+|[{signs}]+$', '', 'g')"


def tidy_sql(x: str, most: int = 38) -> str:
    t = rf"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[&§@#]+\s*[A-Za-z]?[0-9]*', ' ', 'g'), '\s+', ' ', 'g'))"
    for _ in range(3):
        t = rf"trim(regexp_replace({t}, '(?i)^(?:[&§@#]+|[lI1]\s?[0-9]{{1,4}}[A-Za-z]{{0,3}}|[0-9]{{1,3}}|Geno|GENO|EO|OE)\s*', ''))"
    marked = rf"list_transform([{t}], lambda t: CASE WHEN regexp_matches(t, '(?i){START}') AND length(regexp_extract(t, '(?is)^(.*){START}', 1)) < 40 THEN substr(t, length(regexp_extract(t, '(?is)^(.*){START}', 1)) + 1) ELSE t END)"
    spaced = rf"list_transform({marked}, lambda t: {trim_set(rf"regexp_replace(regexp_replace(t, '(?i)^(GEN\s*[0-9])\s*[/·]?\s*', '\1 '), '\s+', ' ', 'g')", r" \-_·./")})"
    last = f"(length(substr(t, 1, {most})) - coalesce(nullif(strpos(reverse(substr(t, 1, {most})), ' '), 0), length(substr(t, 1, {most})) + 1))"
    cut = f"CASE WHEN length(t) > {most} THEN rtrim(CASE WHEN {last} > {most} * 0.5 THEN substr(t, 1, {last}) ELSE substr(t, 1, {most}) END) || '…' ELSE t END"
    return f"list_transform({spaced}, lambda t: CASE WHEN t = '' THEN '未命名' ELSE {cut} END)[1]"


def ui_sql(x: str) -> str:
    n = lambda p: f"len(regexp_extract_all({x}, '{p}'))"
    return (
        f"({n(HAN)} < 4 OR regexp_matches({x}, '{fixed.URLISH}') OR {n(fixed.BRANDS)} >= 3 OR {n(fixed.UI_WORDS)} >= 3"
        f" OR ({n(fixed.MENU_WORDS)} >= 3 AND {n(fixed.FUNCTION_CHARS)} / greatest(1, length({x})) < 0.03))"
    )


@query("f1_normalize_text", r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM documents")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", T.normalize_text("text").alias("text"))


@query("f2_drop_fillers", with_views(["segments"], rf"SELECT video_id, seq, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM segments WHERE NOT regexp_matches(trim(text), '{FILLER}') AND trim(text) <> ''"))
def f2(spark: SparkSession, d: str) -> DataFrame:
    return S.drop_fillers(A.segments(spark, d)).select("video_id", "seq", "text")


@query("f2_dropped_count", with_views(["segments"], f"SELECT video_id, count(*) FILTER (NOT regexp_matches(trim(text), '{FILLER}')) AS kept, count(*) FILTER (regexp_matches(trim(text), '{FILLER}')) AS dropped FROM segments GROUP BY video_id"))
def f2_count(spark: SparkSession, d: str) -> DataFrame:
    return S.dropped_fillers(A.segments(spark, d))


@query("f3_hms", with_views(["segments"], f"SELECT video_id, seq, {A._hms('start * 37')} AS t FROM segments"))
def f3(spark: SparkSession, d: str) -> DataFrame:
    return A.segments(spark, d).select("video_id", "seq", T.hms(F.col("start") * 37).alias("t"))


@query("f6_tokens", with_views(["frames"], f"SELECT video_id, index, list_sort({tokens_sql('text')}) AS tokens FROM frames"))
def f6(spark: SparkSession, d: str) -> DataFrame:
    return A.frames(spark, d).select("video_id", "index", F.array_sort(T.tokens("text")).alias("tokens"))


@query("f7_tokens_lower", with_views(["frames"], f"SELECT video_id, index, list_sort({tokens_lower_sql('text')}) AS tokens FROM frames"))
def f7(spark: SparkSession, d: str) -> DataFrame:
    return A.frames(spark, d).select("video_id", "index", F.array_sort(T.tokens_lower("text")).alias("tokens"))


@query("f8_char_ngrams", with_views(["frames"], f"SELECT video_id, index, list_sort({ngrams_sql('text')}) AS grams FROM frames"))
def f8(spark: SparkSession, d: str) -> DataFrame:
    return A.frames(spark, d).select("video_id", "index", F.sort_array(T.char_ngrams("text")).alias("grams"))


@query(
    "f9_f10_jaccard",
    with_views(
        ["frames"],
        f""", p AS (SELECT video_id, index, {tokens_sql("text")} AS b, lag({tokens_sql("text")}) OVER (PARTITION BY video_id ORDER BY index) AS a FROM frames)
    SELECT video_id, index, {jaccard_sql("a", "b")} AS jaccard, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE {jaccard_sql("a", "b")} END AS strict FROM p WHERE a IS NOT NULL""",
    ),
)
def f9(spark: SparkSession, d: str) -> DataFrame:
    toks = A.frames(spark, d).withColumn("b", T.tokens("text"))
    pairs = toks.withColumn("a", F.lag("b").over(W.partitionBy("video_id").orderBy("index"))).filter("a IS NOT NULL")
    return pairs.select("video_id", "index", T.jaccard("a", "b").alias("jaccard"), T.jaccard_strict("a", "b").alias("strict"))


@query("f12_tidy_title", with_views(["frames"], f"SELECT video_id, index, {tidy_sql('text')} AS title, {tidy_sql("'&l500 12 Geno ' || text")} AS led FROM frames"))
def f12(spark: SparkSession, d: str) -> DataFrame:
    return A.frames(spark, d).select("video_id", "index", T.tidy_title("text").alias("title"), T.tidy_title(F.concat(F.lit("&l500 12 Geno "), "text")).alias("led"))


@query("f13_f14_marks", with_views(["frames"], f"SELECT video_id, index, regexp_matches(text, '{MARK}') AS title_mark, {ui_sql('text')} AS ui FROM frames"))
def f13(spark: SparkSession, d: str) -> DataFrame:
    return A.frames(spark, d).select("video_id", "index", T.is_title_mark("text").alias("title_mark"), T.looks_like_ui_chrome("text").alias("ui"))


URL = "url || CASE WHEN page_id % 2 = 0 THEN '/BV' || lpad(CAST(page_id AS STRING), 10, '7') ELSE '' END"
META_ID = "CASE WHEN page_id % 3 = 0 THEN 'v/' || page_id ELSE '' END"


@query(
    "f16_f19_addresses",
    f"""SELECT page_id, nullif(regexp_extract({URL}, '(BV[0-9A-Za-z]{{10}})', 1), '') AS bvid,
    coalesce(nullif(regexp_replace({META_ID}, '[^A-Za-z0-9_\\-]', '', 'g'), ''), nullif(regexp_extract({URL}, '(BV[0-9A-Za-z]{{10}})', 1), ''), 'work') AS work_key,
    url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 't=' || CAST(trunc(page_id * 1.7) AS BIGINT) AS link FROM pages""",
)
def f16(spark: SparkSession, d: str) -> DataFrame:
    url, meta_id = F.expr(URL), F.expr(META_ID)
    return A.table(spark, d, "pages").select("page_id", T.bvid(url).alias("bvid"), T.work_key(url, meta_id).alias("work_key"), T.jump_link("url", F.col("page_id") * 1.7).alias("link"))


PART_TITLE = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '[-_]\s*[0-9]{{3,4}}[Pp].*$', ''), '(?i)[-_]\s*(高清|标清|超清|AVC|HEVC|AV1)\b.*$', ''), '^\s*[0-9]+[-.][0-9]*[.、\s]*', ''), '^\s*[0-9]+[.、\s]+', '')"""


def part_title_sql() -> str:
    t = trim_set(PART_TITLE, r" \-_·.")
    return f"CASE WHEN {t} <> '' THEN {t} ELSE trim(CASE WHEN title = '' THEN '未命名' ELSE title END) END"


@query("f17_clean_part_title", with_views(["parts"], f"SELECT series_id, pos, {part_title_sql()} AS title FROM parts"))
def f17(spark: SparkSession, d: str) -> DataFrame:
    return A.parts(spark, d).select("series_id", "pos", T.clean_part_title("title").alias("title"))


@query(
    "f18_figure_caption",
    with_views(
        ["frames"],
        f""", t AS (SELECT video_id, index, {tidy_sql("text")} AS title, {A._hms("t")} AS t_str FROM frames)
    SELECT video_id, index, CASE WHEN {ui_sql("title")} THEN printf('图 %d-%d　视频 %s 处画面', 3, index, t_str) ELSE printf('图 %d-%d　%s', 3, index, title) END AS caption FROM t""",
    ),
)
def f18(spark: SparkSession, d: str) -> DataFrame:
    named = A.frames(spark, d).select("video_id", "index", T.tidy_title("text").alias("title"), T.hms("t").alias("t_str"))
    return named.select("video_id", "index", T.figure_caption(F.lit(3), "index", "title", "t_str").alias("caption"))


@query("f21_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def f21(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", T.strip_tags("html").alias("text"))


SIGNATURE = """list_transform([embedding], lambda v: list_transform([list_avg(v)], lambda m: list_transform(v, lambda x: x - m))[1])[1]"""


def signatures_sql() -> str:
    return f"""v AS (SELECT CAST(label AS VARCHAR) AS video_id, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings),
    c AS (SELECT video_id, vec_id, {SIGNATURE} AS c FROM v),
    z AS (SELECT video_id, vec_id, list_transform(c, lambda x: x / coalesce(nullif(sqrt(list_sum(list_transform(c, lambda y: y * y)) / len(c)), 0), 1e-6)) AS sig FROM c),
    s AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY vec_id) - 1 AS index, sig FROM z),
    n AS (SELECT video_id, index, list_sum(list_transform(list_zip(sig, lag(sig) OVER w), lambda p: p[1] * p[2])) / len(sig) AS near FROM s WINDOW w AS (PARTITION BY video_id ORDER BY index))"""


def signatures(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("video_id"), "vec_id", T.signature("embedding").alias("sig"))
    return e.withColumn("index", (F.row_number().over(W.partitionBy("video_id").orderBy("vec_id")) - 1).cast("int")).select("video_id", "index", "sig")


@query("f22_signature_similarity", f"WITH {signatures_sql()} SELECT video_id, index, round(near, 6) AS near FROM n WHERE index > 0")
def f22(spark: SparkSession, d: str) -> DataFrame:
    order = W.partitionBy("video_id").orderBy("index")
    near = signatures(spark, d).select("video_id", "index", T.sig_sim("sig", F.lag("sig").over(order)).alias("near"))
    return near.filter("index > 0").withColumn("near", F.round("near", 6))


@query(
    "a5_visual_baseline",
    f"""WITH {signatures_sql()}, r AS (SELECT video_id, near, row_number() OVER (PARTITION BY video_id ORDER BY near, index) - 1 AS place, count(*) OVER (PARTITION BY video_id) AS n FROM n WHERE index > 0)
    SELECT video_id, round(near, 6) AS baseline, round(greatest(near, 0.66), 6) AS threshold FROM r WHERE place = n // 2""",
)
def a5(spark: SparkSession, d: str) -> DataFrame:
    found = SL.visual_baseline(signatures(spark, d))
    return found.select("video_id", F.round("baseline", 6).alias("baseline"), F.round("threshold", 6).alias("threshold"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Frames with a box for each word, as text recognition gives them: all boxes of a frame together."""

    def box(word: Column, no: Column) -> Column:
        y = F.pmod(no * 137 + F.col("index") * 31, F.lit(500)).cast("double")
        return F.struct(no.alias("box_no"), F.array(F.array(F.lit(0.0), y), F.array(F.lit(9.0), y), F.array(F.lit(9.0), y + 21), F.array(F.lit(0.0), y + 21)).alias("box"), word.alias("text"))

    return A.frames(spark, d).select("video_id", F.col("index").alias("frame"), "file", F.transform(F.split("text", " ", -1), box).alias("boxes"))


@query(
    "f23_subtitle_band",
    with_views(
        ["frames"],
        """, b AS (SELECT video_id, index AS frame, unnest(range(len(l))) AS box_no, unnest(l) AS text FROM (SELECT video_id, index, string_split(text, ' ') AS l FROM frames)),
    y AS (SELECT *, CAST((box_no * 137 + frame * 31) % 500 AS DOUBLE) + 10.5::DOUBLE > 0.78::DOUBLE * 540 AS low FROM b)
    SELECT f.video_id, f.index, f.file, round((f.index + 0.5::DOUBLE) * 10.0::DOUBLE, 1) AS t, coalesce(string_agg(trim(y.text), ' ' ORDER BY box_no) FILTER (NOT low AND trim(y.text) <> ''), '') AS text,
      CAST(coalesce(sum(length(trim(y.text))) FILTER (NOT low), 0) AS INT) AS chars, CAST(count(*) FILTER (low) AS INT) AS dropped
    FROM frames f LEFT JOIN y ON f.video_id = y.video_id AND f.index = y.frame GROUP BY f.video_id, f.index, f.file""",
    ),
)
def f23(spark: SparkSession, d: str) -> DataFrame:
    return SL.subtitle_band_filter(boxes(spark, d))


TERMS = [("第一", "D1"), ("and", "AND"), ("the", "T$H")]


def terms(spark: SparkSession) -> DataFrame:
    by_length = sorted(TERMS, key=lambda x: -len(x[0]))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(by_length)], "ord int, term string, replacement string")


def _latin(t: str, term: str, by: str) -> str:
    for _ in range(2):
        t = f"regexp_replace({t}, '(^|[^A-Za-z0-9]){term}([^A-Za-z0-9]|$)', '\\1' || chr(1) || '\\2', 'gi')"
    return f"replace({t}, chr(1), '{by}')"


def _hits(t: str, term: str) -> str:
    return f"len(regexp_extract_all(regexp_replace({t}, '([^A-Za-z0-9])', '\\1\\1', 'g'), '(?i)(^|[^A-Za-z0-9]){term}([^A-Za-z0-9]|$)'))"


CORRECTED = f"""a AS (SELECT *, {_latin("text", "and", "AND")} AS t1, {_hits("text", "and")} AS h1 FROM paras),
    b AS (SELECT *, {_latin("t1", "the", "T$H")} AS t2, {_hits("t1", "the")} AS h2 FROM a),
    corrected AS (SELECT video_id, para_idx, replace(t2, '第一', 'D1') AS text, CAST(h1 + h2 + len(regexp_extract_all(t2, '第一')) AS INT) AS hits FROM b)"""


@query("f4_f5_apply_terms", with_views(["paras"], f", {CORRECTED} SELECT video_id, para_idx, text, hits FROM corrected"))
def f5(spark: SparkSession, d: str) -> DataFrame:
    return S.apply_terms(A.paragraphs(spark, d), terms(spark)).select("video_id", "para_idx", "text", "hits")


@query(
    "a2_clean_stats",
    with_views(
        ["paras"],
        f""", {CORRECTED}, c AS (SELECT video_id, count(*) AS paragraphs, sum(length(text)) AS chars, sum(hits) AS term_hits FROM corrected GROUP BY video_id)
    SELECT video_id, count(*) FILTER (regexp_matches(trim(text), '{FILLER}')) AS dropped, CAST(any_value(paragraphs) AS BIGINT) AS paragraphs, CAST(any_value(chars) AS BIGINT) AS chars, CAST(any_value(term_hits) AS BIGINT) AS term_hits FROM segments JOIN c USING (video_id) GROUP BY video_id""",
    ),
)
def a2(spark: SparkSession, d: str) -> DataFrame:
    return S.clean_stats(A.segments(spark, d), S.apply_terms(A.paragraphs(spark, d), terms(spark)))


@query(
    "s5_term_map",
    """SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY -length(term), i) - 1 AS INT) AS ord, term, replacement FROM (
    SELECT item_id, unnest(range(len(w))) AS i, unnest(w) AS term, 'to ' || unnest(w) AS replacement FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))""",
)
def s5(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("text", " ", -1)
    raw = A.table(spark, d, "benchmark").select("item_id", F.to_json(F.transform(words, lambda w: F.array(w, F.concat(F.lit("to "), w)))).alias("json"))
    return FI.term_rows(raw)  # one file an item


@query("s7_timed_lines", with_views(["paras"], "SELECT video_id, para_idx, '[' || t || '] ' || text AS line FROM paras"))
def s7(spark: SparkSession, d: str) -> DataFrame:
    return FI.timed_lines(A.paragraphs(spark, d))


@query(
    "s3_normalize_metadata",
    """SELECT CAST(doc_id AS VARCHAR) AS video_id, CAST(doc_id AS VARCHAR) AS id, source AS title, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'channel ' || lang END AS uploader,
    CAST(n_chars AS DOUBLE) AS duration, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'about ' || doc_id END AS description, '' AS license, doc_id % 4 AS n_parts, CASE WHEN doc_id % 4 > 0 THEN 'p1' END AS first_title FROM documents""",
)
def s3(spark: SparkSession, d: str) -> DataFrame:
    entry = lambda i: F.struct((i + 1).alias("playlist_index"), F.concat(F.lit("p"), (i + 1).cast("string")).alias("title"))
    entries = F.when(F.col("doc_id") % 4 > 0, F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 4 - 1).cast("int")), entry))
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    fields = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.when(even, F.col("lang")).otherwise("").alias("uploader"), F.concat(F.lit("channel "), "lang").alias("channel"), F.col("n_chars").cast("double").alias("duration"), F.when(~third, F.concat(F.lit("about "), F.col("doc_id").cast("string"))).alias("description"), entries.alias("entries"))
    raw = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("video_id"), F.to_json(fields).alias("json"))
    found = SE.normalize_metadata(raw)
    return found.select("video_id", "id", "title", "uploader", "duration", "description", "license", F.size("parts").cast("long").alias("n_parts"), F.get("parts", F.lit(0))["title"].alias("first_title"))


@query(
    "s4_list_parts",
    with_views(
        ["parts"],
        """SELECT series_id, pos, index, title, duration, CASE WHEN series_id < 'src5' THEN doc_id END AS cid,
    CASE WHEN series_id < 'src5' THEN 'http://v/' || series_id || '?p=' || index WHEN pos % 2 = 0 THEN 'u' || pos ELSE 'http://v/' || series_id || '?x=1' END AS url FROM parts""",
    ),
)
def s4(spark: SparkSession, d: str) -> DataFrame:
    # a raw page holds so many parts, so that no JSON value grows with its series
    size = 100
    paged = A.parts(spark, d).withColumn("sheet", F.floor(F.col("pos") / size))
    page = F.struct("pos", F.col("index").alias("page"), F.col("title").alias("part"), "duration", F.col("doc_id").alias("cid"))
    entry = F.struct("pos", F.col("index").alias("playlist_index"), "title", "duration", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("u"), F.col("pos").cast("string"))).otherwise("").alias("url"))
    rows = paged.groupBy("series_id", "sheet").agg(F.array_sort(F.collect_list(page)).alias("pages"), F.array_sort(F.collect_list(entry)).alias("entries"))
    api = F.to_json(F.struct(F.struct(F.col("pages").alias("pages")).alias("data")))
    raw = rows.select("series_id", F.concat(F.lit("http://v/"), "series_id", F.lit("?x=1")).alias("url"), F.when(F.col("series_id") < "src5", api).otherwise(F.to_json(F.struct("entries"))).alias("json"))
    return SE.list_parts(raw).withColumn("pos", F.col("index") - 1)
