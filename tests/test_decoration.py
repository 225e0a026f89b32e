"""Decoration of slides: counts by chunks against plain counts, and cleaning against the expression of functions.text."""

import random
import re
from collections import Counter

import pytest

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators import decoration as D

FRAME = "video_id string, index int, text string, chunk_ string"


def plain_chrome(texts, ratio=0.4, gram_ratio=0.6, isolated_ratio=0.3):
    """Every item of every text counted."""
    words, grams, alone = Counter(), Counter(), Counter()
    for t in texts:
        t = t or ""
        words.update(set(re.findall(r"[A-Za-z][A-Za-z0-9_\-]*", t)))
        runs = re.findall("[一-鿿]+", t)
        grams.update({r[i : i + n] for r in runs for n in range(2, 9) for i in range(len(r) - n + 1)})
        alone.update(w for w in t.split() if len(w) == 1 and re.match("[一-鿿]", w))
    n = len(texts)
    out = {w.lower() for w, c in words.items() if c >= n * ratio} | {g for g, c in grams.items() if c >= n * gram_ratio}
    return sorted(out | {a for a, c in alone.items() if c >= n * isolated_ratio} | set(fixed.CHROME_WORDS))


def videos(rnd, count):
    """Texts of videos whose frames share some of a few pieces."""
    out = {}
    for v in range(count):
        pieces = ["".join(rnd.choice("甲乙丙丁戊的是在") for _ in range(rnd.randint(1, 9))) for _ in range(6)] + ["GEN 1", "Abc-d", "品", " 品 ", "3/12", "x1", "&", "　"]
        often = rnd.sample(pieces, 3)
        out[f"v{v}"] = [" ".join([p for p in often if rnd.random() < 0.7] + rnd.choices(pieces, k=rnd.randint(0, 4))) for _ in range(rnd.randint(1, 40))]
    return out


@pytest.mark.parametrize("chunk", [3, 7, 256])
def test_chunks_of_a_video_count_as_one(spark, chunk):
    made = videos(random.Random(chunk), 40)
    rows = [(v, i, t, None) for v, texts in made.items() for i, t in enumerate(texts)]
    got = {r["video_id"]: r["chrome"] for r in D.detect_chrome(spark.createDataFrame(rows, FRAME), chunk=chunk).collect()}
    assert got == {v: plain_chrome(texts) for v, texts in made.items()}


def test_a_long_video_is_many_groups(spark):
    # without its null text the video would have one frame less; "稀有" passes in one chunk alone
    rows = [("long", i, None if i == 5 else f"导航 第{i}页 {'稀有' if i < 300 else '内容'} w{i % 2}", "extra") for i in range(4000)] + [("one", 0, "只有一帧的内容", None)]
    df = spark.createDataFrame(rows, FRAME).repartition(8)
    got = {r["video_id"]: r["chrome"] for r in D.detect_chrome(df).collect()}
    assert got == {"long": plain_chrome([r[2] for r in rows[:-1]]), "one": plain_chrome(["只有一帧的内容"])}
    assert "导航" in got["long"] and "稀有" not in got["long"] and "内容" in got["long"]
    clean = D.clean_frames(df)
    assert clean.columns == [*df.columns, "clean"]
    by = {(r["video_id"], r["index"]): r for r in clean.collect()}
    assert len(by) == 4001 and by["long", 7]["clean"] == "第7页 稀有" and by["long", 5]["clean"] == "" and by["long", 5]["text"] is None
    assert by["one", 0]["clean"] == "" and by["long", 9]["chunk_"] == "extra"
    assert D.clean_frames(df.limit(0)).count() == 0


def test_cleaner_and_expression_agree(spark):
    rnd = random.Random(9)
    signs = ["甲", "乙", "丙", "丁", "品", " ", "　", "a", "B1", "x/y", "12/ 30", "7", "&", "§", "結", "é1/2", "\x85", "\n", "-"]
    rows = []
    for _ in range(1500):
        chrome = ["".join(rnd.choice("甲乙丙丁品") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 6))] + rnd.sample(["a", "b1", "x/y", "7", "甲 乙", "é1", "结论"], rnd.randint(0, 3))
        rows.append(("".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))), sorted(set(chrome))))
    df = spark.createDataFrame(rows, "text string, chrome array<string>")
    for r in df.withColumn("clean", T.clean_slide("text", "chrome")).collect():
        assert D.Cleaner(r["chrome"])(r["text"]) == r["clean"], (r["text"], r["chrome"])


def test_text_is_dealt_by_video_and_chunk(spark):
    """What moves a frame has both keys, and no join holds one."""
    df = spark.createDataFrame([("v", 0, "导航 甲", None)], FRAME)
    plan = D.clean_frames(df)._jdf.queryExecution().executedPlan().toString()
    top, below = plan.split("Union", 1)
    assert "hashpartitioning(video_id" in top and "chunk_" in top.split("hashpartitioning(")[1].split(",")[1] and "Join" not in top
    assert "frame_" not in below[below.index("Join") :]


def test_a_frame_of_decoration_alone():
    text = "我们这是每一帧都有的正文内容" * 40
    grams = {text[i : i + n] for n in range(2, 9) for i in range(len(text) - n)}
    assert D.Cleaner([*grams])(text + " 3/12") == text
