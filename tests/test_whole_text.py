"""The views and queries hold every character, word and part; their SQL, which is whole as well, is compared in test_queries."""

import tempfile

from lectern.plans import adapters as A
from lectern.plans.queries import ORACLES, QUERIES


def test_frames_and_segs_hold_all_characters(spark):
    line = lambda n: "".join(A.LATIN[i % 26] + " " * (i % 7 == 6) for i in range(n))
    docs = [(1, line(5000)), (2, line(700) + "\n" + "z" * 4000)]
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    lines = {(str(i), k): t.translate(str.maketrans(A.LATIN, A.HAN)) for i, text in docs for k, t in enumerate(text.split("\n"))}
    frames = {(r["video_id"], r["index"]): r["text"] for r in A.frames(spark, path).collect()}
    assert {k: t.removesuffix(f" {k[1] + 1} / 120 ") for k, t in frames.items()} == lines
    segs = A.segs(spark, path).orderBy("video_id", "seg").collect()
    for video in ("1", "2"):
        words = [w for (v, _), t in sorted(frames.items()) if v == video for w in t.split(" ") if w]
        assert [w for s in segs if s["video_id"] == video for w in s["text"].split(" ") if w] == words
    assert max(len(s["text"].split(" ")) for s in segs) <= 8


def test_all_parts_are_listed(spark, tmp_path):
    docs = spark.range(460).selectExpr("id AS doc_id", "concat('part ', id) AS text", "if(id < 230, 'src1', 'src7') AS source", "10L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["s4_list_parts"](spark, str(tmp_path)).collect()
    assert sorted((r["series_id"], r["pos"], r["index"]) for r in rows) == [(s, i, i + 1) for s in ("src1", "src7") for i in range(230)]


def test_registered_sql_has_no_cut():
    for cut in ("substr(line, 1,", "substr(text, 1, 200)", "[1:6]", "pos < 50", "index % 4 = 1"):
        assert not [n for n, sql in ORACLES.items() if cut in sql]
