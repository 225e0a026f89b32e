"""Expressions on small Chinese and Latin texts."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalise_and_fillers(spark):
    assert one(spark, T.normalize_text(F.lit(" a　\n b "))) == "a b"
    assert one(spark, T.normalize_text(F.lit(None).cast("string"))) == ""
    said = {"嗯嗯，": True, "就是": True, "好": False, "好吧": True, "对吧。": True, "对吧我说": False, "": True}
    assert {k: one(spark, T.is_filler(F.lit(k))) for k in said} == said


def test_hms_truncates_and_does_not_wrap(spark):
    assert one(spark, T.hms(F.lit(59.99))) == "00:00:59"
    assert one(spark, T.hms(F.lit(90061.0))) == "25:01:01"


def test_two_jaccards(spark):
    empty = F.array().cast("array<string>")
    ab, bc = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))
    assert one(spark, T.jaccard(empty, empty)) == 0.0
    assert one(spark, T.jaccard_strict(empty, empty)) == 1.0
    assert one(spark, T.jaccard(ab, bc)) == pytest.approx(1 / 3)


def test_ngrams(spark):
    assert one(spark, T.char_ngrams(F.lit("a-b c"))) == []
    assert one(spark, T.char_ngrams(F.lit("我们，用 AI 写"))) == ["我们用A", "们用AI", "用AI写"]


def chrome_of(*items):
    return F.array(*map(F.lit, items))


def test_clean_slide(spark):
    got = one(spark, T.clean_slide(F.lit("Gen0 GEN1 结论 复盘报告 3/12 品 向量检索是这样的"), chrome_of("gen0", "gen1", "结论", "复盘报告", "品")))
    assert got == "向量检索是这样的"


def test_clean_slide_falls_back_if_too_much_goes(spark):
    chrome = chrome_of("这是每一帧都有的正文内容")
    assert one(spark, T.clean_slide(F.lit("这是每一帧都有的正文内容 3/12"), chrome)) == "这是每一帧都有的正文内容"


@pytest.mark.parametrize(
    ("given", "title"),
    [("&l500 12 向量检索", "12 向量检索"), ("", "未命名"), ("导航 菜单 第三章 检索", "第三章 检索"), ("gen2/回顾", "gen2 回顾"), ("word " * 20, "word word word word word word word…")],
)
def test_tidy_title(spark, given, title):
    got = one(spark, T.tidy_title(F.lit(given)))
    assert got == title or given.startswith("&") and "&" not in got


def test_ui_chrome(spark):
    ui = ["文件 开始 插入 引用 邮件 视图", "百度 京东 淘宝 天猫 网址大全", "www.example.com 打开网页看一看", "File Edit View"]
    content = ["我们用向量检索来找到最相近的文档", "工具的设计和格式要与团队约定一致", "这套方案在生产环境里跑了半年", "插入新的数据之前先检查索引的状态"]
    assert all(one(spark, T.looks_like_ui_chrome(F.lit(t))) for t in ui)
    assert not any(one(spark, T.looks_like_ui_chrome(F.lit(t))) for t in content)


@pytest.mark.parametrize(("name", "title"), [("3-3.基础搭建-1080P 高清-AVC", "基础搭建"), ("12. 开始", "开始"), ("", "未命名"), ("课程_高清", "课程")])
def test_part_title(spark, name, title):
    assert one(spark, T.clean_part_title(F.lit(name))) == title


def test_signature_ignores_brightness(spark):
    a = F.array(*[F.lit(float(x)) for x in (1, 5, 2, 8)])
    b = F.array(*[F.lit(float(x + 30)) for x in (1, 5, 2, 8)])
    assert one(spark, T.sig_sim(T.signature(a), T.signature(b))) > 0.95
    flat = F.array(F.lit(3.0), F.lit(3.0))
    assert one(spark, T.signature(flat)) == [0.0, 0.0]
    assert one(spark, T.sig_sim(F.lit(None).cast("array<double>"), T.signature(a))) == 0.0
