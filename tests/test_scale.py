"""What grows with the tables: no text sorted or moved where a row is enough, and work in proportion to a text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import align as AL
from lectern.operators import book as B
from lectern.operators import decoration as D
from lectern.operators import slides as SL
from lectern.plans import adapters as A
from lectern.plans import book_queries as BQ
from lectern.plans import chapter_queries as CQ
from lectern.plans import text_queries as TQ
from lectern.plans.queries import QUERIES
from lectern.sources.stages import keep


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_frames_are_dealt_as_documents(spark, sf_dir):
    """One exchange, of whole documents; lines are neither sorted nor put through a window."""
    for df in (A.frames(spark, sf_dir), TQ.f13(spark, sf_dir)):
        plan = plan_of(df)
        assert plan.count("RepartitionByExpression [doc_id") == 1 and "Window" not in plan and "Sort " not in plan


def test_short_slides_are_numbered_in_their_document(spark, sf_dir):
    """One exchange, of whole documents; slides are not sorted to be numbered, and choosing chapters reads documents once."""
    for df in (A.segs(spark, sf_dir), SL.title_marked(A.segs(spark, sf_dir))):
        plan = plan_of(df)
        assert plan.count("RepartitionByExpression [doc_id") == 1 and "Window" not in plan and "Sort " not in plan
    assert "documents" not in CQ.chosen(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_boxes_of_a_frame_stay_together(spark, sf_dir):
    plan = plan_of(TQ.f23(spark, sf_dir))
    assert "Aggregate" not in plan and "Join" not in plan
    y = lambda a: [[0.0, a], [9.0, a], [9.0, a + 20], [0.0, a + 20]]
    rows = [("v", 0, "a", [(1, y(5.0), " low no "), (0, y(0.0), "first"), (2, y(500.0), "sub"), (3, y(9.0), None)]), ("v", 1, "b", None), ("v", 2, "c", [])]
    df = spark.createDataFrame(rows, "video_id string, frame int, file string, boxes array<struct<box_no:int,box:array<array<double>>,text:string>>")
    got = {r["index"]: (r["text"], r["chars"], r["dropped"], r["t"]) for r in SL.subtitle_band_filter(df).collect()}
    assert got == {0: ("first low no", 11, 1, 5.0), 1: ("", 0, 0, 15.0), 2: ("", 0, 0, 25.0)}


def test_grams_of_a_long_line(spark):
    """Time in proportion to the line, where it grew with its square."""
    df = spark.range(1).select(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(400_000)), lambda i: F.concat(F.lit("字"), (i % 100).cast("string")))).alias("text"))
    df = df.localCheckpoint()
    start = time.monotonic()
    assert df.select(F.size(T.char_ngrams("text"))).first()[0] == 290
    assert time.monotonic() - start < 20
    assert spark.createDataFrame([("a-b字",), ("a b c d e",), (None,)], "text string").select(F.sort_array(T.char_ngrams("text")).alias("g")).collect() == [([],), (["abcd", "bcde"],), ([],)]


def test_text_of_a_programs_frame_by_four_signs(spark):
    df = spark.createDataFrame([("一二三a",), ("一a二b三 四",), ("",), (None,), ("甲" * 3 + "x" * 100_000,)], "text string")
    assert [r[0] for r in df.select(T.looks_like_ui_chrome("text")).collect()] == [True, False, True, True, True]


def test_rows_of_a_book_render_as_its_text(spark):
    """Without the book in one value; headings and rules inside paragraphs, table rows, and chapters without text included."""
    rnd = random.Random(4)
    texts = ["plain", "# heading", "---", "| a | b |  ", "a\n# two\n---\nb  ", "> said", "![x](f1.jpg){width=6.5in}", "![y](f2.jpg)", "<b> & 'c'", "", "# "]
    meta = [(v, v, "", None, None, None, rnd.choice(["", "# about\nit"]), "", None, None) for v in "abc"]
    m = spark.createDataFrame(meta, "video_id string, title string, subtitle string, author string, lang string, rights string, about string, source_note string, time_link string, content_frames int")
    c = spark.createDataFrame([(v, i, f"ch {i}", i * 10 - 10, i * 10) for v in "abc" for i in range(1, 4)], "video_id string, ch int, title string, from_idx int, to_idx int")
    p = spark.createDataFrame([(v, i, float(i), i + 1.0, rnd.choice(texts), "00:00:01") for v in "abc" for i in range(0 if v == "a" else 5, 25)], "video_id string, para_idx int, start double, end double, text string, t string")
    f = spark.createDataFrame([("a", 3, "before", 1, "cap", "f1.jpg"), ("a", 3, "before", 2, "cap", "f2.jpg"), ("b", 7, "after", 1, "cap", "f1.jpg")], "video_id string, para_index int, pos string, k int, caption string, rel string")
    q = spark.createDataFrame([("a", 1, "quote", "00:00:01")], "video_id string, ord int, text string, at string")
    there = spark.createDataFrame([("a", "f1.jpg"), ("b", "f2.jpg")], "video_id string, file string")
    rows = lambda df: sorted(map(tuple, df.select("video_id", "ch", "title", "body").collect()))
    args = (m, c, p, f, None, q)
    assert rows(B.render_rows(B.book_rows(*args), there)) == rows(B.render_xhtml(B.assemble_book(B.book_lines(*args)), there))


def test_audit_of_a_book_of_many_documents(spark):
    """Beginnings that no document holds are not searched for anew in each of them."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("ab字 &") for _ in range(n))
    docs = [("v", "<p>" + "</p>\n<p>".join(word(rnd.randint(0, 40)) for _ in range(3)) + "</p>") for _ in range(300)] + [("w", "<p>x</p>"), ("only", None)]
    paras = [("v", word(rnd.randint(0, 30))) for _ in range(400)] + [("v", d[1][4 : 4 + rnd.randint(1, 60)]) for d in docs[:300]] + [("w", "y"), ("w", ""), ("w", "x"), ("none", "z"), ("none", "")]
    plain = [(v, "" if h is None else __import__("re").sub("<[^>]+>", "", h)) for v, h in docs]
    want = {v: sum(any(v == d and t[:24] in h for d, h in plain) or t == "" for x, t in paras if x == v) for v in ("v", "w", "none", "only")}
    got = B.coverage_audit(spark.createDataFrame(paras, "video_id string, text string"), spark.createDataFrame(docs, "video_id string, html string"))
    assert {r["video_id"]: r["covered"] for r in got.collect()} == want
    start = time.monotonic()
    many = spark.range(20_000).selectExpr("'v' AS video_id", "concat('lost beginning ', id) AS text")
    html = spark.range(4000).selectExpr("'v' AS video_id", "concat('<p>document ', id, '</p>') AS html")
    assert B.coverage_audit(many, html).first()["covered"] == 0
    assert time.monotonic() - start < 60


def test_signatures_move_no_text(spark):
    """Signatures are told to the fold; no join holds a frame's text."""
    rows = [("v", i, i * 10.0, f"{i}.jpg", f"第{i}页讲的是向量检索的方法{'甲乙丙丁'[i % 4] * 9}") for i in range(6)] + [(None, 0, 0.0, "n.jpg", "没有编号的视频也有内容页")]
    clean = spark.createDataFrame(rows, "video_id string, index int, t double, file string, clean string")
    sigs = spark.createDataFrame([("v", i, [1.0, -1.0] if i in (0, 3) else [1.0, 1.0] if i == 2 else None) for i in range(9)] + [(None, 0, [1.0, 1.0])], "video_id string, index int, sig array<double>")
    seen = []
    whole = SL.fold_in_chunks
    try:
        SL.fold_in_chunks = lambda rows, *a: seen.append(rows) or whole(rows, *a)
        got = SL.select_representatives(clean, sigs, max_sim=0.99)
    finally:
        SL.fold_in_chunks = whole
    plan = plan_of(seen[0])
    assert "Join" not in "".join(line for line in plan.split("Union", 1)[0]) and "clean#" not in plan[plan.index("Join") :]
    assert {(r["video_id"], r["file"]) for r in got.collect()} == {("v", f"{i}.jpg") for i in (0, 1, 2, 4, 5)} | {(None, "n.jpg")}


def test_a_programs_frame_in_a_fold_and_as_expression(spark):
    rnd = random.Random(6)
    words = ["百度", "BiliBili", "1688", "12306", "58同城", "另存为", "工具箱", "批注", "页眉", "文件", "开始", "插入", "的", "了", "字", "甲", "www.", "HTTPS://", ".CN", "vpn", "ＶＰＮ", "K", "ſ", "x", " ", "\n"]
    texts = ["".join(rnd.choices(words[:16] if rnd.random() < 0.7 else words, k=rnd.randint(0, 14))) + "字" * rnd.choice([0, 4, 90]) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    said = [(r["text"], r["ui"]) for r in df.select("text", T.looks_like_ui_chrome("text").alias("ui")).collect()]
    assert {ui for _, ui in said} == {True, False} and [t for t, ui in said if SL.ui_chrome(t) != ui] == []


def test_slides_are_parted_as_frames_are_cleaned(spark):
    """One pass over the frames that cleans and compares them; what is sorted by video is slides. Chunks make no difference."""
    rnd = random.Random(7)
    words = ["检索", "方法", "甲乙", "丙丁", "GEN 1", "Abc-d", "x1", "字", "&", ""]
    rows = []
    for v in range(30):
        text = ""
        for i in range(rnd.randint(1, 30)):
            text = text if rnd.random() < 0.4 else " ".join(["导航栏", *rnd.choices(words, k=rnd.randint(0, 5))])
            rows.append((f"v{v}", i, i * 10.0, f"{i}.jpg", text + " " * rnd.randint(0, 1), i))
    df = spark.createDataFrame(rows, "video_id string, index int, t double, file string, text string, chars int")
    tokens = lambda t: set(__import__("re").findall("[一-鿿]|[A-Za-z][A-Za-z0-9_\\-]*", t))
    want, last = {}, {}
    for r in sorted(D.clean_frames(df).collect(), key=lambda r: (r["video_id"], r["index"])):
        v, now = r["video_id"], tokens(r["clean"])
        if v not in last or len(last[v] & now) / max(1, len(last[v] | now)) < 0.5:
            want.setdefault(v, []).append([])
        last[v] = now
        want[v][-1].append(r)
    longest = lambda s: max(s, key=lambda r: (len(r["clean"]), -r["index"]))["clean"].strip()
    whole = {(v, i, s[0]["t"], s[-1]["t"] + 10, s[0]["file"], longest(s), len(s)) for v, all_ in want.items() for i, s in enumerate(all_)}
    names = ["video_id", "seg", "t0", "t1", "file", "text", "frames"]
    for given in (df, D.clean_frames(df)):
        for chunk in (3, 256):
            got = SL.slide_intervals(given, chunk=chunk)
            assert {tuple(r) for r in got.select(names).collect()} == whole
            assert {(r["video_id"], r["seg"], r["t"], r["text"]) for r in SL.slide_segments(given, chunk=chunk).collect()} == {(w[0], w[1], w[2], w[5]) for w in whole}
    plan = plan_of(SL.slide_intervals(df))
    assert plan.count("RepartitionByExpression") == 1 and "regexp_extract_all(clean" not in plan


def test_books_read_frames_once_and_without_text(spark, sf_dir):
    """Figures are placed by times alone; a book's rows are made once, then counted and rendered."""
    assert BQ.listed(spark, sf_dir).columns == ["video_id", "t0", "file"]
    slides = spark.createDataFrame([("v", 0.0, "a.jpg"), ("v", 3.0, "b.jpg")], "video_id string, t double, file string")
    chapters = spark.createDataFrame([("v", 1, 0, 1)], "video_id string, ch int, from_idx int, to_idx int")
    paras = spark.createDataFrame([("v", 0, 0.0, 9.0)], "video_id string, para_idx int, start double, end double")
    got = AL.assign_to_chapters(slides, chapters, paras)
    assert "ocr" not in got.columns and [r["file"] for r in got.orderBy("k").collect()] == ["a.jpg", "b.jpg"]
    long = AL.assign_to_chapters(slides.withColumn("text", F.repeat(F.lit("字"), 200)), chapters, paras)
    assert {r["ocr"] for r in long.collect()} == {"字" * 120}
    plan = BQ.f20(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "documents" not in plan and "conversations" not in plan
    assert "documents" not in BQ.a6(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_videos_in_one_row_are_picked_by_themselves(spark, sf_dir, monkeypatch):
    """Frames of videos of usual length are neither dealt nor folded by chunks, and give what frames that are dealt give."""
    rnd = random.Random(8)
    pieces = ["导航 首页", "第一章的内容", "讲的是向量检索", "Gen1 结论", "甲乙丙丁戊己", "品", "3/12", "&", "图片与文字的说明", ""]
    rows = [(f"v{v}", i, i * 10.0, f"{i}.jpg", rnd.choice([" ".join(rnd.choices(pieces, k=rnd.randint(1, 6))), None if i % 9 == 8 else "重复的一页内容"])) for v in range(30) for i in range(rnd.randint(1, 40))]
    frames = spark.createDataFrame(rows, "video_id string, index int, t double, file string, text string")
    packed = F.array_sort(F.collect_list(F.struct("index", "t", "file", "text")))
    videos = frames.groupBy("video_id").agg(F.count("*").cast("int").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), packed.alias("frames"))
    sigs = spark.createDataFrame([(f"v{v}", i, rnd.choice([[1.0, -1.0], [1.0, 1.0], [-1.0, 1.0], None])) for v in range(0, 40, 2) for i in range(0, 50, 2)] + [(None, 0, [1.0, 1.0])], "video_id string, index int, sig array<double>")
    got = lambda df: sorted(map(tuple, df.select("video_id", "pick", "t0", "t1", "file", "text", "title", "chars", "dup_to_prev", "img_dup").collect()))
    for told in (None, sigs):
        want = got(SL.select_representatives(D.clean_frames(frames), told, min_chars=4))
        assert len(want) > 60
        # none are long, some are by frames, some by characters, all are
        for most in ({}, {"most_frames": 20}, {"most_chars": 150}, {"most_frames": 0}):
            assert got(SL.representatives_of_videos(videos, told, min_chars=4, **most)) == want
    monkeypatch.setattr(SL, "fold_in_chunks", None)
    monkeypatch.setattr(D, "_told", None)
    df = QUERIES["w6_select_representatives"](spark, sf_dir)
    plan = plan_of(df)
    assert plan.count("RepartitionByExpression") == 1 and "RepartitionByExpression [video_id" in plan
    assert df.count() > 0


def test_slides_with_speech_hold_no_more_text_than_figures_show(spark, sf_dir, monkeypatch):
    """Frames are read once, as whole videos; what is kept of a slide's text is what is shown; slides without speech go in the join."""
    kept = []
    monkeypatch.setattr(BQ, "keep", lambda df: kept.append(df) or keep(df))
    monkeypatch.setattr(A, "frames", None)
    figures = QUERIES["wb_slides_to_figures"](spark, sf_dir)
    assert figures.count() > 0
    assert kept[0].agg(F.max(F.length("text"))).first()[0] <= AL.SHOWN
    slides = spark.createDataFrame([("v", 0.0, 3.0), ("v", 3.0, 6.0), ("w", 0.0, 3.0)], "video_id string, t0 double, t1 double")
    said = spark.createDataFrame([("v", 0, 0.0, 1.0, "x" * 12), ("v", 1, 2.0, 4.0, " yy ")], "video_id string, seq int, start double, end double, text string")
    for least, want in ((3, [("v", 0.0, 14)]), (2, [("v", 0.0, 14), ("v", 3.0, 2)]), (0, [("v", 0.0, 14), ("v", 3.0, 2), ("w", 0.0, 0)])):
        spoken = AL.attach_speech(slides, said, min_speech=least)
        assert sorted(map(tuple, spoken.select("video_id", "t0", "speech_chars").collect())) == want
        assert ("LeftOuter" in plan_of(spoken)) == (least == 0)


def test_kept_stages_are_small(spark):
    df = spark.range(50_000).selectExpr("id", "concat('的是在结章论', id % 97, '和一了规律就也都很把被') AS text")
    assert all(f.endswith(".zstd.parquet") for f in keep(df).inputFiles())


def test_chapters_in_one_row_render_as_their_book(spark):
    """Headings, rules, table rows and line breaks inside paragraphs, and figures on either side, included; nothing is dealt."""
    rnd = random.Random(9)
    texts = ["plain", "# heading", "---", "| a | b |  ", "a\n# two\n---\nb  ", "a\r# no # no heading", "> said", "![x](f1.jpg){width=6.5in}", "![y](f2.jpg)", "<b> & 'c'", "", "# "]
    meta = [(v, v, "", None, None, None, "", "", link, None) for v, link in (("a", "http://x?y=1"), ("b", None))]
    m = spark.createDataFrame(meta, "video_id string, title string, subtitle string, author string, lang string, rights string, about string, source_note string, time_link string, content_frames int")
    c = spark.createDataFrame([(v, i, f"ch {i}", i * 6 - 6, i * 6 if i < 4 else 18, i, rnd.choice(["led", "", None])) for v in "ab" for i in range(1, 5)], "video_id string, ch int, title string, from_idx int, to_idx int, part int, intro string")
    p = spark.createDataFrame([(v, i, i + 0.5, i + 1.0, rnd.choice(texts), f"00:00:{i:02}") for v in "ab" for i in range(18)], "video_id string, para_idx int, start double, end double, text string, t string")
    f = spark.createDataFrame([(v, rnd.randint(0, 17), rnd.choice(["before", "after"]), rnd.randint(1, 2), rnd.choice("xy&"), rnd.choice(["f1.jpg", "f2.jpg"])) for v in "ab" for _ in range(15)], "video_id string, para_index int, pos string, k int, caption string, rel string")
    there = spark.createDataFrame([("a", "f1.jpg"), ("b", "f1.jpg")], "video_id string, file string")
    whole = B.render_rows(B.book_rows(m, c, p, f, None, None), there).filter("ch > 1").orderBy("video_id", "ch")
    want = [(r["video_id"], r["title"], r["body"].rstrip("\n")) for r in whole.collect()]
    within = lambda x, i: (F.col(f"x.{i}") >= F.col("c.from_idx")) & (F.col(f"x.{i}") < F.col("c.to_idx"))
    key = ["video_id", "ch"]
    told = lambda x, i, as_, *names: c.alias("c").join(x.withColumnRenamed("video_id", "v").alias("x"), (F.col("c.video_id") == F.col("v")) & within(x, i)).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(f"x.{i}").alias("para_idx"), *names))).alias(as_))
    at = p.select("video_id", F.col("para_idx").alias("from_idx"), "start", "t")
    rows = c.join(told(p, "para_idx", "paras", "text"), key, "left").join(told(f, "para_index", "figures", "pos", "k", "caption", "rel"), key, "left").join(at, ["video_id", "from_idx"], "left").join(m.select("video_id", "time_link"), "video_id")
    stamp = F.when(F.col("from_idx") < F.col("to_idx"), F.concat(F.format_string("P%d ", "part"), "t")).otherwise("-")
    empty = {n: F.coalesce(n, F.array().cast(dict(rows.dtypes)[n])) for n in ("paras", "figures")}
    made = B.chapter_rows(rows.withColumns(empty | {"stamp": stamp, "files": F.array(F.lit("f1.jpg"))}))
    got = [(r["video_id"], d["title"], d["body"].rstrip("\n")) for r in made.orderBy(*key).collect() for d in r["docs"]]
    assert got == want and len(want) > 12 and any("<figure>" in b for *_, b in want)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_beginnings_found_in_place_or_in_blocks(spark, monkeypatch, most):
    rnd = random.Random(10)
    word = lambda n: "".join(rnd.choice("ab字𝄞 &") for _ in range(n))
    docs = [(rnd.choice("vw"), "\n".join(word(rnd.randint(0, 30)) for _ in range(3))) for _ in range(200)] + [("x", ""), (None, "ab字")]
    sought = {(rnd.choice("vwxy"), (word(rnd.randint(1, 9)) if rnd.random() < 0.7 else rnd.choice(docs)[1][3:27]).replace("\n", "a") or "a") for _ in range(400)}
    monkeypatch.setattr(B, "TOLD_MARKS", most)
    monkeypatch.setattr(B, "BLOCK_CHARS", 500)
    got = B._begun_elsewhere(spark.createDataFrame(sorted(sought), "video_id string, prefix string"), spark.createDataFrame(docs, "video_id string, plain string"))
    want = {(v, p) for v, p in sought if any(v == d and p in t for d, t in docs)}
    assert set(map(tuple, got.collect())) == want and 50 < len(want) < len(sought)


def test_parts_of_a_series_are_rendered_where_they_lie(spark, sf_dir, monkeypatch):
    """Documents are dealt once, as whole rows; no line of theirs is put in a range, a window or a group, nor kept but as rendered."""
    monkeypatch.setattr(A, "frames", None)
    monkeypatch.setattr(B, "in_index_range", None)
    rendered, kept = [], []
    whole = B.render_rows
    monkeypatch.setattr(B, "render_rows", lambda rows, *a: rendered.append(rows) or whole(rows, *a))
    monkeypatch.setattr(BQ, "keep", lambda df: kept.append(df) or keep(df))
    assert QUERIES["wc_series_to_audit"](spark, sf_dir).count() > 0
    assert {r["part"] for r in rendered[0].select("part").distinct().collect()} == {0, 2}
    bodies = [df for df in kept if "docs" in df.columns]
    assert [df.columns for df in bodies] == [["video_id", "ch", "title", "stamp", "chars", "begins", "docs"]]
    plan = plan_of(bodies[0])
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan
