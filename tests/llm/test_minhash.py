import random

import pytest

import corpus_pipeline as P
from lectern.llm import minhash
from test_simhash import components


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The ids that a stage on both kinds of links keeps: the smallest of each component."""
    of = {i: root for i, _, root in components(rows)}
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    ids = sorted(of)
    for i in ids:
        for j in ids:
            if i < j and of[i] != of[j] and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((of[i], of[j]))
                of = {k: low if r == high else r for k, r in of.items()}
    return {i for i in ids if of[i] == i}


def planted():
    """Texts with copies whose shingle sets are 0.66 to 0.95 alike, and a chain of copies of copies."""
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    docs = []
    for _ in range(25):
        words = [word() for _ in range(200)]
        docs.append(words)
        for changes in (1, 2, 3, 4, 6):
            copy = list(words)
            for i in random.sample(range(0, 200, 8), changes):
                copy[i] = word()
            docs.append(copy)
    for _ in range(8):
        docs.append(list(docs[-1]))
        for i in random.sample(range(0, 200, 8), 3):
            docs[-1][i] = word()
    random.shuffle(docs)
    return [(i, " ".join(d), "en", "a", 0) for i, d in enumerate(docs)]


def test_stage_finds_all_pairs_from_0_8(spark, sf_dir):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute(df.collect())
    assert len(want) < 60
    assert {r["doc_id"] for r in P.simhash_stage(spark, df, sf_dir).collect()} == want


def test_given(spark, given, sf_dir):
    docs = P.durable(P.exact_stage(spark, given[0], sf_dir))
    assert {r["doc_id"] for r in P.simhash_stage(spark, docs, sf_dir).collect()} == brute(docs.collect())


@pytest.mark.parametrize("text", ["", "a b", "a b c d e", "x " * 5000])
def test_keys(text):
    hashes = minhash.shingles(text)
    assert len(hashes) == len(shingle_set(text))
    assert len(minhash.band_keys(hashes, minhash._permutations())) == (minhash.BANDS if text else 0)


def test_prefixes_lose_no_similar_pair_and_make_few_others(spark):
    rows = planted()
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    nodes = spark.createDataFrame([(i, i, len(s)) for i, s in sets.items()], "id_ long, root_ long, n int")
    made = minhash._sets(spark.createDataFrame([(i, t) for i, t, *_ in rows], "id_ long, text string"))
    got = {tuple(sorted((r["x"], r["y"]))) for r in minhash._prefix_pairs(nodes, made, 0.8).collect()}
    assert want <= got


def test_a_large_group_below_0_8_makes_few_pairs(spark):
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    base, rows = [word() for _ in range(200)], []
    for i in range(300):
        copy = list(base)
        for j in random.sample(range(0, 200, 10), 9):
            copy[j] = word()
        rows.append((i, " ".join(copy)))
    made = minhash._sets(spark.createDataFrame(rows, "id_ long, text string"))
    nodes = spark.createDataFrame([(i, i, len(shingle_set(t))) for i, t in rows], "id_ long, root_ long, n int")
    assert minhash._prefix_pairs(nodes, made, 0.8).count() < 300
