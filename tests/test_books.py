"""Parts, introductions and images of books, audits and searches that stay linear, hygiene without moving texts."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import book as B
from lectern.operators import chapters as C
from lectern.operators import hygiene as H
from lectern.operators import segments as S
from lectern.sources import files as FI

PARA = "video_id string, para_idx int, start double, end double, text string, t string"
CHAPTER = "video_id string, ch int, title string, from_idx int, to_idx int, part int, intro string"
META = "video_id string, title string, subtitle string, author string, lang string, rights string, about string, source_note string, time_link string, content_frames int"


def paras(spark, *texts):
    return spark.createDataFrame([("v", i, i * 10.0, i * 10 + 9.0, t, f"00:00:{i}0") for i, t in enumerate(texts)], PARA)


def test_parts_and_introductions(spark):
    p = paras(spark, "第一段", "第二段", "第三段")
    chapters = spark.createDataFrame([("v", 1, "甲", 0, 2, 1, "先说"), ("v", 2, "乙", 2, 3, 2, ""), ("v", 3, "丙", 3, 3, 3, None)], CHAPTER)
    toc = {r["ch"]: (r["stamp"], r["chars"]) for r in C.chapter_toc(chapters, p).collect()}
    assert toc == {1: ("P1 00:00:00", 6), 2: ("P2 00:00:20", 3), 3: ("-", 0)}
    meta = spark.createDataFrame([("v", "书", None, None, None, None, "", "", "http://v", None)], META)
    none = lambda schema: spark.createDataFrame([], schema)
    lines = B.book_lines(meta, chapters, p, none("video_id string, para_index int, pos string, k int, caption string, rel string"), none("video_id string, ord int, term string, desc string, at string"), none("video_id string, ord int, text string, at string"))
    book = B.assemble_book(lines).first()["book"].split("\n")
    at = book.index("# 第1章 甲")
    assert book[at : at + 8] == ["# 第1章 甲", "", "> 视频时间点：P1 00:00:00 起（[跳转原片](http://v?t=0)）", "", "【本章导读】先说", "", "第一段", ""]
    assert "| 2 | 乙 | P2 00:00:20 | 3 |" in book and sum("导读" in x for x in book) == 1


def test_audit_counts_images_and_books_without_paragraphs(spark):
    p = paras(spark, "甲" * 30, "乙" * 10 + "没有的", "", "a<b and more text than a prefix", "甲" * 24 + "other")
    html = spark.createDataFrame([("v", '<p>甲' + "甲" * 29 + '</p><img src="f/1.jpg" alt="x"/><img src="f/1.jpg"/><img src="f/2.jpg"/><p>a&lt;b and more</p>'), ("w", "<p>x</p>")], "video_id string, html string")
    got = {r["video_id"]: r.asDict() for r in B.coverage_audit(p, html).collect()}
    assert got["v"] | {"src_chars": 0} == {"video_id": "v", "src_chars": 0, "paragraphs": 5, "covered": 3, "coverage": 60.0, "images": 2, "ok": False}
    assert got["w"] == {"video_id": "w", "src_chars": 0, "paragraphs": 0, "covered": 0, "coverage": 0.0, "images": 0, "ok": False}
    alone = B.coverage_audit(p, html.limit(0)).first()
    assert (alone["paragraphs"], alone["covered"], alone["ok"]) == (5, 1, False)


def test_a_book_of_50000_paragraphs(spark, monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("的是在结章论和一了规律就也", k=30)) + str(i) for i in range(50_000)]
    p = spark.createDataFrame([("v", i, 0.0, 1.0, t, "00:00:00") for i, t in enumerate(texts)], PARA)
    html = "".join(f"<p>{t}</p>" for i, t in enumerate(texts) if i % 100)
    got = B.coverage_audit(p, spark.createDataFrame([("v", html)], "video_id string, html string")).first()
    assert (got["paragraphs"], got["covered"], got["ok"]) == (50_000, 49_500, True)
    glossary = spark.createDataFrame([("v", k, f"{t[5:20]}（x）", "d", None) for k, t in enumerate(texts[::2500])] + [("v", 900, "/none", "d", None), ("v", 901, "没有这个", "d", ""), ("v", 902, texts[3], "d", "00:00:09")], "video_id string, ord int, term string, desc string, at string")
    timed = p.withColumn("t", F.col("para_idx").cast("string"))
    at = {r["ord"]: r["at"] for r in B.first_mention(glossary, timed).collect()}
    assert at == {k: str(next(i for i, x in enumerate(texts) if t[5:20] in x)) for k, t in enumerate(texts[::2500])} | {900: "", 901: "", 902: "00:00:09"}


def test_many_terms(spark):
    """10,000 terms, some made by others, against one pattern after the other."""
    import re

    rnd = random.Random(3)
    terms = sorted({("".join(rnd.choices("abAB东京 ", k=rnd.randint(2, 5))).strip(), "".join(rnd.choices("abc东$\\", k=3))) for _ in range(400)} - {("", "")}, key=lambda x: (-len(x[0]), x))
    terms = [(a, b) for a, b in terms if a] + [(f"unused{i}", "x") for i in range(9_000)]
    texts = ["".join(rnd.choices("abABc东京 ，", k=60)) for _ in range(40)] + ["", None]

    def plain(t):
        if t is None:
            return None, 0
        hits = 0
        for term, by in terms:
            pattern = re.escape(term)
            if re.fullmatch(r"[A-Za-z0-9 ._\-]+", term):
                pattern = f"(?<![A-Za-z0-9]){pattern}(?![A-Za-z0-9])"
            t, n = re.subn(pattern, lambda m: by, t, flags=re.I)
            hits += n
        return t, hits

    listed = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(terms)], "ord int, term string, replacement string")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: (r["text"], r["hits"]) for r in S.apply_terms(rows, listed).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        S.apply_terms(rows, listed, 100)


def test_hygiene_moves_no_text(spark):
    files = spark.createDataFrame([("r", "node_modules/a.txt", 9, "x"), ("r", "a/.venv/b.py", 9, "x"), ("s", "build/cookie.txt", 9, "x"), ("s", "cookie.txt", 9, "x"), ("s", "x/build/c.txt", 5, "x")], "root string, path string, size long, text string")
    ignored = spark.createDataFrame([("s", "build")], "root string, name string")
    found = H.scan(files, ignored)
    assert {tuple(r)[:4] for r in found.collect()} == {("r", "node_modules", "folder", "warning"), ("r", "a/.venv", "folder", "blocking"), ("s", "cookie.txt", "name", "blocking")}
    report = {r["root"]: tuple(r)[1:] for r in H.report(H.prune_folders(files, ignored)[0], found).collect()}
    assert report == {"r": (0, 0, 1, 1, False), "s": (2, 14, 1, 0, False)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [block for block in plan.split("\n\n") if ") Exchange" in block]
    assert moved and not any("text#" in block for block in moved)
    top = H.top_findings(found, 1)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert {(r["root"], r["level"], r["more"]) for r in top.collect()} == {("r", "warning", 0), ("r", "blocking", 0), ("s", "blocking", 0)}


def test_a_missing_term_file(spark, tmp_path):
    assert FI.load_term_map(spark, f"{tmp_path}/none.json").count() == 0
