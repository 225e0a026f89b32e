"""Folds, chapters, alignment and books on small made-up videos."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import align as AL
from lectern.operators import book as B
from lectern.operators import chapters as C
from lectern.operators import decoration as D
from lectern.operators import hygiene as H
from lectern.operators import ordered as O
from lectern.operators import segments as S
from lectern.operators import slides as SL
from lectern.sources import files as FI

SEG = "video_id string, seq int, start double, end double, text string"
FRAME = "video_id string, index int, t double, file string, text string, chars int"
PARA = "video_id string, para_idx int, start double, end double, text string, t string"


def segments(spark, *rows):
    return spark.createDataFrame([("v", i, *r) for i, r in enumerate(rows)], SEG)


def test_paragraphs_take_the_segment_after_a_pause(spark):
    df = segments(spark, (0.0, 1.0, "一"), (1.1, 2.0, "嗯"), (5.0, 6.0, "二"), (6.1, 7.0, "三"))
    got = [(r["start"], r["end"], r["text"]) for r in S.to_paragraphs(df).orderBy("para_idx").collect()]
    assert got == [(0.0, 6.0, "一二"), (6.1, 7.0, "三")]


def test_paragraphs_close_by_length_and_sentence(spark):
    df = segments(spark, (0.0, 1.0, "长" * 300), (1.0, 2.0, "短"), (2.0, 3.0, "字" * 108 ), (3.0, 4.0, "完了。"), (4.0, 5.0, "新"))
    assert [len(r["text"]) for r in S.to_paragraphs(df).orderBy("para_idx").collect()] == [301, 111, 1]
    assert S.to_paragraphs(df.limit(0)).count() == 0


def test_many_videos_fold_apart(spark):
    df = spark.createDataFrame([(f"v{v}", i, i * 1.0, i + 0.9, f"t{i}") for v in range(20) for i in range(50)], SEG)
    got = S.to_paragraphs(df, max_len=40).groupBy("video_id").agg(F.sum(F.length("text")).alias("n"), F.max("para_idx").alias("p")).collect()
    assert len(got) == 20 and {r["n"] for r in got} == {140} and {r["p"] for r in got} == {3}


def test_terms_apply_in_order_at_latin_borders(spark):
    rows = spark.createDataFrame([(1, "用Jason和Persona，月签到cost$1；open cloud"), (2, None)], "id int, text string")
    terms = spark.createDataFrame([(0, "open cloud", "OpenCloud"), (1, "jason", "JSON"), (2, "月签", "跃迁"), (3, "son", "x"), (4, "cost", "a$1\\b")], "ord int, term string, replacement string")
    got = {r["id"]: (r["text"], r["hits"]) for r in S.apply_terms(rows, terms).collect()}
    assert got[1] == ("用JSON和Persona，跃迁到a$1\\b$1；OpenCloud", 4)


def frames(spark, texts, step=10.0):
    return spark.createDataFrame([("v", i, (i + 0.5) * step, f"f{i}.jpg", t, len(t)) for i, t in enumerate(texts)], FRAME)


def test_chrome_and_islands(spark):
    texts = ["向量检索是这样的方法", "向量检索是这样的方法呀", "完全另外的一页内容", "第四页讲到如何切章", "最末页致谢再会"]
    df = frames(spark, ["导航栏 Gen0 " + t for t in texts])
    chrome = D.detect_chrome(df).first()["chrome"]
    assert "gen0" in chrome and "导航栏" in chrome and "导航" in chrome
    segs = SL.slide_segments(D.clean_frames(df)).orderBy("seg").collect()
    assert [(r["t"], r["text"]) for r in segs] == [(5.0, texts[1]), (25.0, texts[2]), (35.0, texts[3]), (45.0, texts[4])]


def test_group_slides_against_gathered_tokens(spark):
    df = frames(spark, ["甲乙丙丁" * 6, "甲乙丙戊" * 6, "完全不同" * 6])
    got = SL.group_slides(df).orderBy("seg").collect()
    assert [(r["n_frames"], r["file"], r["span"]) for r in got] == [(2, "f0.jpg", 20.0), (1, "f2.jpg", 10.0)]


def test_title_cards_keep_the_longer_of_near_ones(spark):
    segs = spark.createDataFrame([("v", 0, 10.0, "第一章 开", 5), ("v", 1, 20.0, "第一章 开始", 6), ("v", 2, 55.0, "小结一下", 4), ("v", 3, 90.0, "无标记的页", 5)], "video_id string, seg int, t double, text string, chars int")
    assert [r["seg"] for r in SL.pick_title_cards(segs).orderBy("seg").collect()] == [1, 2]


def test_representatives_are_unlike(spark):
    a, b = "我们用向量检索来找到最相近的文档片段", "另外一页讲的是如何切分章节和标题"
    df = frames(spark, [a, a + "吗", b, a, "短"])
    got = SL.select_representatives(df.withColumn("clean", F.col("text"))).orderBy("pick").collect()
    assert [(r["t0"], r["t1"]) for r in got] == [(5.0, 25.0), (25.0, 35.0)]


def paras(spark, n=40, step=10.0, length=9.0):
    return spark.createDataFrame([("v", i, i * step, i * step + length, f"第{i}段文字", "00:00:00") for i in range(n)], PARA)


def test_description_strategy(spark):
    desc = "简介\n00:00 开场\n· 01:40 - 检索\n[03:20] 总结\nnot 4"
    videos = spark.createDataFrame([("v", desc)], "video_id string, description string")
    marks = C.parse_description(videos).orderBy("mark").collect()
    assert [(m["t"], m["title"]) for m in marks] == [(0.0, "开场"), (100.0, "检索"), (200.0, "总结")]
    none = spark.createDataFrame([], "video_id string, seg int, t double, text string, chars int")
    got = C.choose_chapters(paras(spark), videos, none, none).orderBy("ch").collect()
    assert [(r["from_idx"], r["to_idx"], r["strategy"]) for r in got] == [(0, 10, "description"), (10, 20, "description"), (20, 40, "description")]


def test_slides_then_time(spark):
    cards = spark.createDataFrame([("v", i, t, x, 5) for i, (t, x) in enumerate([(100.0, "第一章 甲"), (200.0, "第二章 乙"), (300.0, "第三章 丙")])], "video_id string, seg int, t double, text string, chars int")
    empty = spark.createDataFrame([("v", "")], "video_id string, description string")
    got = C.choose_chapters(paras(spark), empty, cards, cards).orderBy("ch").collect()
    assert [(r["title"], r["from_idx"], r["to_idx"]) for r in got] == [("开篇", 0, 10), ("第一章 甲", 10, 20), ("第二章 乙", 20, 30), ("第三章 丙", 30, 40)]
    got = C.choose_chapters(paras(spark), empty, cards.limit(1), cards.limit(1), minutes=3.0).orderBy("ch").collect()
    assert [r["auto"] for r in got] == ["time"] * 2 and got[0]["title"] == "第1章" and got[1]["title"] == "第一章 甲"


def test_overlap_join_is_strict_and_binned(spark):
    slides = spark.createDataFrame([("v", 0.0, 130.0), ("v", 130.0, 140.0)], "video_id string, t0 double, t1 double")
    df = segments(spark, (0.0, 5.0, " 一" * 10), (55.0, 65.0, "二" * 10), (129.0, 130.0, "三" * 10), (130.0, 131.0, "四" * 20))
    got = {r["t0"]: r["speech"] for r in AL.attach_speech(slides, df).collect()}
    assert got == {0.0: ("一 " * 10).strip() + "二" * 10 + "三" * 10, 130.0: "四" * 20} or got[130.0] == "四" * 20 and got[0.0].endswith("三" * 10)


def test_a_slide_has_one_chapter(spark):
    slides = spark.createDataFrame([("v", float(t), t + 10.0, f"{t}.jpg", "文字内容", "一个够长的标题", 0.0, "说的话") for t in (0, 95, 96, 150)], "video_id string, t0 double, t1 double, file string, text string, title string, dup_to_prev double, speech string")
    chapters = spark.createDataFrame([("v", 1, "a", 0, 10), ("v", 2, "b", 10, 40)], "video_id string, ch int, title string, from_idx int, to_idx int")
    got = AL.to_figures(slides, chapters, paras(spark)).orderBy("chapter", "k").collect()
    assert [(r["chapter"], r["t"], r["para_index"]) for r in got] == [(1, 0.0, 0), (1, 95.0, 9), (1, 96.0, 9), (2, 150.0, 15)]


def test_gate(spark):
    videos = spark.createDataFrame([("v",), ("w",)], "video_id string")
    slides = spark.createDataFrame([("v",)] * 5, "video_id string")
    assert {r["video_id"]: r["skip_reason"] for r in AL.talking_head_gate(videos, slides).collect()} == {"v": None, "w": "talking_head"}


def random_rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("vw"), i, rng.choice([None, *map(float, range(0, 300, 7))])) for i in range(n)]


@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of_meets_what_a_full_join_meets(spark, later, strict):
    rows, others = random_rows(80, 1), random_rows(90, 2)
    left = spark.createDataFrame(rows, "video_id string, id int, t double")
    right = spark.createDataFrame(others, "video_id string, para_idx int, at double")
    got = {r["id"]: r["found"] for r in O.as_of(left, right, ["video_id"], "t", "at", F.min("other.para_idx"), later, strict).collect()}
    fits = lambda a, t: None not in (a, t) and (a != t or not strict) and (a >= t if later else a <= t)
    assert got == {i: min((j for w, j, a in others if w == v and fits(a, t)), default=None) for v, i, t in rows}


def test_ranges_meet_what_a_full_join_meets(spark):
    rng = random.Random(3)
    ranges = [(rng.choice("vw"), i, *[rng.randrange(0, 400) for _ in "ab"]) for i in range(40)] + [("v", 98, 5, None), ("w", 99, 0, 10**9)]
    points = [(v, i, t) for v, i, t in random_rows(300, 4)]
    df = spark.createDataFrame(ranges, "video_id string, ch int, lo int, hi int")
    met = O.in_index_range(df, spark.createDataFrame(points, "video_id string, para_idx int, t double"), "lo", "hi")
    want = sorted((c, i) for v, c, lo, hi in ranges for w, i, _ in points if v == w and hi is not None and lo <= i < hi)
    assert sorted((r["ch"], r["para_idx"]) for r in met.collect()) == want
    times = df.select("video_id", "ch", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    met = O.in_time_range(times, spark.createDataFrame(points, "video_id string, id int, t double"), "lo", "hi", "t")
    want = sorted((c, i) for v, c, lo, hi in ranges for w, i, t in points if v == w and None not in (hi, t) and lo <= t <= hi)
    assert sorted((r["ch"], r["id"]) for r in met.collect()) == want


def test_a_very_long_video(spark):
    """50,000 paragraphs and 5,000 marks of one video: pairs would be 250 million."""
    p = spark.range(50000).select(F.lit("v").alias("video_id"), F.col("id").cast("int").alias("para_idx"), (F.col("id") * 10.0).alias("start"), (F.col("id") * 10.0 + 10).alias("end"), F.lit("00:00:00").alias("t"), F.lit("text").alias("text"))
    marks = spark.range(5000).select(F.lit("v").alias("video_id"), F.col("id").alias("mark"), (F.col("id") * 100.0 + 1).alias("t"), F.lit("a title").alias("title"))
    chapters = C.marks_to_ranges(marks, p)
    assert chapters.filter("from_idx = (ch - 1) * 10 AND to_idx = least(ch * 10 + 1, 50000)").count() == 5000
    assert C.chapter_toc(chapters, p).filter("chars = 44 OR ch = 5000 AND chars = 40").count() == 5000


def test_coverage_counts_escaped_prefixes_as_lost(spark):
    p = spark.createDataFrame([("v", 0, "plain text"), ("v", 1, "a & b")], "video_id string, para_idx int, text string")
    html = spark.createDataFrame([("v", "<p>plain</p> <p>plain text</p><p>a &amp; b</p>")], "video_id string, html string")
    got = B.coverage_audit(p, html).first()
    assert (got["covered"], got["coverage"], got["ok"]) == (1, 50.0, False)


def test_hygiene(spark):
    rows = [("r", "notes.md", 10, "AKIA" + "A" * 16), ("r", "my_token.py", 10, ""), ("r", "id_rsa", 10, ""), ("r", "tokenize.md", 10, ""), ("r", "a/node_modules/x.md", 1, ""), ("r", ".venv/x.md", 1, ""), ("r", "build/cookie.txt", 1, "")]
    files = spark.createDataFrame(rows, "root string, path string, size long, text string")
    ignored = spark.createDataFrame([("r", "build")], "root string, name string")
    got = {(r["path"], r["kind"], r["level"]) for r in H.scan(files, ignored).collect()}
    assert got == {("notes.md", "secret", "blocking"), ("my_token.py", "name", "warning"), ("id_rsa", "name", "blocking"), ("a/node_modules", "folder", "blocking"), (".venv", "folder", "warning")}


def test_files(spark, tmp_path):
    folder = tmp_path / "v1"
    folder.mkdir()
    (folder / "asr_segments.json").write_text('[{"start": 1, "end": 2.5, "text": "一"}, {"start": 3, "end": 4, "text": "二"}]')
    (folder / "frames_ocr.json").write_text('[{"index": 0, "file": "f.jpg", "t": 5.0, "text": "三", "chars": 1, "dropped": 0}]')
    got = FI.read_segments(spark, f"{tmp_path}/*/asr_segments.json").orderBy("seq").collect()
    assert [tuple(r) for r in got] == [("v1", 0, 1.0, 2.5, "一"), ("v1", 1, 3.0, 4.0, "二")]
    assert FI.read_frames(spark, f"{tmp_path}/*/frames_ocr.json").first()["text"] == "三"
    for i, text in enumerate(['{"map": {"GPT": "a", "GPT-4o": "b"}}', '{"GPT": "a", "GPT-4o": "b"}', '[["GPT", "a"], ["GPT-4o", "b"]]']):
        (tmp_path / f"t{i}.json").write_text(text)
        assert [r["term"] for r in FI.load_term_map(spark, f"{tmp_path}/t{i}.json").orderBy("ord").collect()] == ["GPT-4o", "GPT"]
    assert FI.load_term_map(spark, None).count() == 0
    (folder / "frames_ocr.json").write_text('[{"index": 0, "file": "f.jpg", "t": 5.0, "te')
    with pytest.raises(Exception, match="no JSON array.*frames_ocr"):
        FI.read_frames(spark, f"{tmp_path}/*/frames_ocr.json").collect()
    FI.write_timed_text(paras(spark, 3), f"{tmp_path}/out", 2)
    assert spark.read.text(f"{tmp_path}/out").filter("value like '[00:00:00]%'").count() == 3


def test_stage_reads_back_by_video(spark, tmp_path):
    rows = [(f"v{i % 7}", i, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "video_id string, seq int, text string")
    for form, buckets in (("parquet", 4), ("json", None)):
        for _ in range(2):  # a rerun replaces the stage
            FI.write_stage(df, f"{tmp_path}/{form}", buckets, form)
        back = spark.read.schema(df.schema).format(form).load(f"{tmp_path}/{form}")
        assert sorted(map(tuple, back.collect())) == sorted(rows)
        places = back.select("video_id", "_metadata.file_path").distinct().collect()
        assert len({r["video_id"] for r in places}) == len(places) == 7


def test_chapter_table_reads_back(spark, tmp_path):
    toc = spark.createDataFrame([("v", 0, 'a "title", 一'), ("v", 1, "b")], "video_id string, chapter int, title string")
    FI.write_chapter_table(toc, f"{tmp_path}/toc")
    back = spark.read.csv(f"{tmp_path}/toc", header=True, schema=toc.schema, escape="\\")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, toc.collect()))


@pytest.mark.parametrize("operator", [S.to_paragraphs, S.dropped_fillers])
def test_empty(spark, operator):
    assert operator(spark.createDataFrame([], SEG)).count() == 0
