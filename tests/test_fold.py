"""Folds over chunks of a video against the same folds over whole videos."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import segments as S
from lectern.operators import slides as SL

SEG = "video_id string, seq int, start double, end double, text string"
FRAME = "video_id string, index int, t double, file string, text string, chars int"


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def frames(rnd, counts):
    words = ["向量检索是这样的方法", "另外一页讲如何切分章节", "GEN 1 总结", "word other words", "很长的一段文字在这里说明", "的是在和了"]
    out = []
    for v, n in counts:
        for i in range(n):
            text = " ".join(rnd.choices(words, k=rnd.randint(0, 3))) + "甲乙丙丁戊"[: rnd.randint(0, 5)]
            out.append((v, i, i * 10.0, f"{i}.jpg", text, len(text)))
    return out


@pytest.mark.parametrize("chunk", [7])
def test_chunks_give_the_rows_of_whole_videos(spark, chunk):
    rnd = random.Random(chunk)
    counts = [("a", 1), ("b", 60), (None, 35), ("c", 2), ("d", 18)]
    df = spark.createDataFrame(frames(rnd, counts), FRAME)
    assert rows_of(SL.group_slides(df, 0, 0.0, chunk=chunk)) == rows_of(SL.group_slides(df, 0, 0.0))
    clean = df.withColumn("clean", F.col("text"))
    sigs = df.select("video_id", "index", F.array(F.sin("t"), F.cos("t"), F.lit(0.5)).alias("sig")).filter("index % 3 > 0")
    assert rows_of(SL.select_representatives(clean, sigs, chunk=chunk)) == rows_of(SL.select_representatives(clean, sigs))
    segs = [(v, i, i * 2.0 + rnd.random(), i * 2.0 + 1 + rnd.random(), rnd.choice(["字" * rnd.randint(1, 90), "完了。", "嗯"])) for v, n in counts for i in range(n)]
    s = spark.createDataFrame(segs, SEG)
    assert rows_of(S.to_paragraphs(s, chunk=chunk)) == rows_of(S.to_paragraphs(s))
    assert S.to_paragraphs(s.limit(0), chunk=chunk).count() == 0


def test_a_fold_that_never_forgets(spark):
    """Segments that never end a paragraph: each chunk depends on all before it, and the video is folded whole at last."""
    s = spark.createDataFrame([("v", i, i * 1.0, i + 1.0, "a") for i in range(48)] + [("w", i, i * 3.0, i * 3 + 1.0, "b") for i in range(20)], SEG)
    got = S.to_paragraphs(s, 10**6, chunk=8)
    assert rows_of(got) == rows_of(S.to_paragraphs(s, 10**6))
    assert got.filter("video_id = 'v'").first()["text"] == "a" * 48


def test_a_long_video_runs_in_many_tasks(spark):
    """60,000 segments with a pause now and then: as the same fold in plain Python has them."""
    n = 60_000
    made = spark.range(n).selectExpr("'v' AS video_id", "CAST(id AS INT) AS seq", "id * 1.0D AS start", "id + IF(id % 97 = 0 OR id % 1009 = 5, 0.05D, 1.0D) AS end", "concat(repeat('字', CAST(3 + id % 7 AS INT)), IF(id % 3 = 0, '。', '')) AS text")
    fold, want = S.Paragraphs("v", 200, 110, 0.9), []
    for row in made.collect():
        want += fold.step(row.asDict())
    want += fold.end()
    got = S.to_paragraphs(made, chunk=4096).drop("t").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(w.values()) for w in want)
