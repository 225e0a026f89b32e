import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import langid, quality, queries

MID = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = queries.op2_language(spark, MID)
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97


def test_language_learns_nothing_from_held_out_rows(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    wrong = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    a, b = langid.learn_languages(docs), langid.learn_languages(wrong)
    assert a.langs == b.langs and np.array_equal(a.logs, b.logs)


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = langid.learn_languages(spark.read.parquet(f"{MID}/documents.parquet"))
    got = odd_docs.select("doc_id", model.predict("text").alias("p")).select("doc_id", "p.*").collect()
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1, 2, 3)} == {i: ("und", 0.0) for i in (1, 2, 3)}
    assert all(r["lang_pred"] in model.langs for r in got if r["doc_id"] in (4, 5, 6, 7, 8, 9))
    nothing = langid.learn_languages(no_docs)
    assert odd_docs.select(nothing.predict("text").alias("p")).filter("p.lang_pred <> 'und'").count() == 0
    assert no_docs.select(model.predict("text")).count() == 0


def test_mixture_is_the_most_likely(spark):
    rng = np.random.default_rng(3)
    words = np.log(np.concatenate([rng.dirichlet([8, 1, 1], 70), rng.dirichlet([1, 8, 1], 30)])).astype(np.float32)
    model = langid.LanguageModel(["a", "b", "c"], np.zeros((1, 3), np.float32))
    chosen, share = model.mixture(words)
    grid = max(((np.log(np.exp(words[:, :2]) @ [p, 1 - p]).sum(), p) for p in np.linspace(0.01, 0.99, 99)))[1]
    assert sorted(chosen) == [0, 1] and share[chosen.index(0)] == pytest.approx(grid, abs=0.05)
    assert model.mixture(words[:70])[0] == [0]


def auc(score, label):
    good, bad = score[label == 1], score[label == 0]
    return ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2).item()


def test_quality_held_out(spark):
    got = queries.op5_quality(spark, MID)
    rows = got.join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{MID}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert auc(np.array([r["score"] for r in held]), np.array([r["quality"] for r in held])) >= 0.93


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.learn_quality(docs, labels) == quality.learn_quality(docs, flipped)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 1), (6, 0), (7, 0), (8, 0), (99, 1), (None, 0), (9, None)], "doc_id long, quality int")
    model = quality.learn_quality(odd_docs, labels)
    got = odd_docs.select("doc_id", model.score("text").alias("s")).collect()
    assert len(got) == 11 and all(0 <= r["s"] <= 1 for r in got)
    assert len({r["s"] for r in got if r["doc_id"] in (1, 2)}) == 1
    one = quality.learn_quality(odd_docs, labels.filter("quality = 1"))
    assert {r["s"] for r in odd_docs.select(one.score("text").alias("s")).collect()} == {1.0}
    assert quality.learn_quality(no_docs, labels.limit(0)).share == 0.5
    assert no_docs.select(model.score("text")).count() == 0
