import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as P
from lectern.llm import mixing, packing, quality
from test_minhash import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert len(names) == len(set(names)) == 5
    outs = []
    for i, (_, stage) in enumerate(P.STAGES):
        before = docs.collect()
        docs = P.durable(stage(spark, docs, sf_dir))
        outs.append((before, docs.collect()))
        assert i == 4 or docs.columns == COLUMNS
    (b, a) = outs[0]
    model = quality.learn_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    sizes = quality.Sizes(model.good, model.bad) if model.good else None
    scores = model.scores([r["text"] or "" for r in b], sizes)
    assert Counter(a) == Counter(r for r, s in zip(b, scores) if s >= 0.3)
    (b, a) = outs[1]
    groups = defaultdict(list)
    for r in b:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    assert Counter(a) == Counter(min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"])) for g in groups.values())
    (b, a) = outs[2]
    near = brute(b)
    assert Counter(a) == Counter(r for r in b if r["doc_id"] in near)
    (b, a) = outs[3]
    copies = {r["doc_id"]: r["copies"] if r["size"] else 1 for r in mixing.mix(spark.createDataFrame(b)).collect()}
    assert Counter(r["doc_id"] for r in a) == Counter({i: n for i, n in copies.items() if n})
    (b, a) = outs[4]
    lengths = Counter()
    for r in a:
        lengths[r["doc_id"]] += r["length"]
    made = packing.tokenize_pieces(spark.createDataFrame(b)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert lengths == Counter({r["doc_id"]: r["n"] for r in made})


#: Columns that the stages might use themselves.
CLASHING = ["component_id", "row", "row_", "copies", "id_", "sha_", "score_", "key", "size", "target"]


def test_empty_and_odd_tables(spark, odd_docs, sf_dir, no_docs):
    for df in (no_docs, odd_docs):
        docs = df
        for name in CLASHING[1:]:
            docs = docs.withColumn(name, F.lit(name))
        for i, (_, stage) in enumerate(P.STAGES):
            columns, docs = docs.columns, P.durable(stage(spark, docs, sf_dir))
            assert i == 4 or docs.columns == columns
            assert i == 4 or all(r[c] == c for r in docs.collect() for c in CLASHING[1:])
        assert df is odd_docs or docs.count() == 0


def test_rows_are_told_apart_whatever_their_ids(spark, sf_dir):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, words(1), "a"), (1, words(2), "a"), (None, words(3), "a"), (None, words(4), "a"), (-(2**63), words(5), "a"), (1, words(1), "a"), (7, words(3) + " ", "a"), (8, None, "a"), (9, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = P.durable(P.exact_stage(spark, docs, sf_dir))
    # of equal texts the longest one stays, then the one with the smallest id
    want = Counter([rows[0], rows[1], rows[6], rows[3], rows[4], rows[7]])
    assert Counter(map(tuple, kept.collect())) == want
    near = P.durable(P.simhash_stage(spark, kept, sf_dir))
    assert Counter(map(tuple, near.collect())) == want
    mixed = Counter(map(tuple, P.mixing_stage(spark, near, sf_dir).collect()))
    assert mixed == want
