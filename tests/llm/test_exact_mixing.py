import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import exact, mixing, queries


@pytest.mark.parametrize("name", ["op6_exact", "op9_mix", "op10_chat"])
def test_same_as_sql(name, spark, sf_dir, same):
    same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name])


def test_exact_odd_rows(odd_docs):
    rows = odd_docs.collect()
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    members = defaultdict(list)
    for r in rows:
        members[squeeze(r["text"])].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"]))
    for r, want in zip(exact.exact_groups(odd_docs).orderBy(F.col("doc_id").asc_nulls_last()).collect(), sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"]))):
        group = sorted(members[squeeze(want["text"])])
        assert (r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) == (want["doc_id"], group[0][2], len(group), want["doc_id"] == group[0][2])


def test_chunks_keep_the_text(spark):
    text = "css" * 700 + "x" * 9000 + "Ss" + "y" * 600 + "\n"
    got = spark.createDataFrame([(text,)], "text string").select(F.regexp_extract_all("text", F.lit(exact.CHUNK), F.lit(0)).alias("c"), "text").first()
    assert "".join(got["c"]) == got["text"] and max(map(len, got["c"])) <= 8194 and len(got["c"]) > 4


@pytest.mark.parametrize("script", ["abcdefghijklmnopqrstuvwxyz ", (0x4E00, 0x9FFF), (0x621, 0x64A), (0xAC00, 0xD7A3), (0x400, 0x4FF), (0x3041, 0x3096), (0x905, 0x939), (0x20000, 0x2A6DF)])
def test_chunks_of_all_scripts_follow_their_content(spark, script):
    letters = script if isinstance(script, str) else list(map(chr, range(*script)))
    text = "".join(random.Random(3).choices(letters, k=60000))
    made = spark.createDataFrame([(text,), (letters[0] + text,)], "text string")
    one, two = (Counter(r["c"]) for r in made.select(F.regexp_extract_all("text", F.lit(exact.CHUNK), F.lit(0)).alias("c")).collect())
    assert (one & two).total() > 0.8 * one.total() and one.total() > 20


def test_exact_rows_told_apart(spark):
    rows = [(None, "a", 0), (None, "a", 1), (-(2**63), "b c", 2), (7, "b  c", 3), (7, "b  c", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    kept = {r["row"]: r["kept"] for r in exact.exact_groups(df, ["row"]).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: True, 4: False}
    assert [r["kept"] for r in exact.exact_groups(df).collect()].count(True) == 4


def test_clashing_identifiers_are_found_and_replaced(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "abc" * (i % 3 + 1)) for i in range(9)], "doc_id long, text string")
    real = exact.recipes
    monkeypatch.setattr(exact, "recipes", lambda d, row=None: real(d, row).withColumn("recipe", F.transform("recipe", lambda c: F.struct(F.lit(7).cast("long").alias("id"), c["digest"].alias("digest")))))
    assert {r["doc_id"]: r["keep_id"] for r in exact.exact_groups(docs).collect()} == {i: i % 3 for i in range(9)}


def test_empty(no_docs):
    assert exact.exact_groups(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0


def water_fill(sizes, weights):
    """Targets by resharing what is above a limit, until none is."""
    total, stopped = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in stopped}
        left = total - sum(stopped.values())
        shares = {s: left * w / sum(free.values()) for s, w in free.items()}
        above = {s: 3.0 * sizes[s] for s, x in shares.items() if x > 3 * sizes[s]}
        if not above:
            return stopped | shares
        stopped |= above


@pytest.mark.parametrize("docs", ["given", "odd_docs"])
def test_mix(docs, request):
    fixture = request.getfixturevalue(docs)
    df = fixture[0] if docs == "given" else fixture
    rows = mixing.mix(df, bucket_rows=16).collect()
    assert len(rows) == df.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    names = sorted(sizes, key=lambda s: (s is None, s))
    want = water_fill(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    longest = max(r["size"] for r in rows)
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= longest
    assert sum(taken.values()) <= sum(sizes.values())
    numbered = mixing.mix(df.withColumn("row", F.monotonically_increasing_id()), bucket_rows=16, row=["row"])
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in numbered.collect()) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)
    again = sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.mix(df.repartition(3), bucket_rows=16).collect())
    assert again == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)
