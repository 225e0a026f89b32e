"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lectern.llm import runs
from lectern.llm.queries import op11_runs


def plain_runs(words, min_length=6, min_exponent=4):
    """Each period in turn: stretches of equal words so far apart, without those that have a smaller period."""
    ids = np.unique(np.asarray(words, object), return_inverse=True)[1] if words else np.empty(0, int)
    n, out = len(ids), []
    for q in range(1, n // min_exponent + 1):
        same = np.r_[0, (ids[q:] == ids[:-q]).astype(int), 0]
        for s, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            length = int(e - s) + q
            if length >= max(min_length, min_exponent * q):
                seg = ids[s : s + length]
                if not any(q % p == 0 and (seg[p:] == seg[:-p]).all() for p in range(1, q)):
                    out.append((int(s), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (6, 3), (1, 4), (9, 2)])
def test_find_runs(least):
    rnd = random.Random(repr(least))
    for _ in range(1500):
        words = [b"%d" % rnd.randrange(rnd.choice([1, 2, 2, 3, 5])) for _ in range(rnd.randint(0, 50))]
        for _ in range(rnd.randint(0, 3)):
            s, p = rnd.randint(0, len(words)), rnd.randint(1, 8)
            words[s:s] = words[s : s + p] * rnd.randint(2, 6)
        assert runs.find_runs(words, *least) == plain_runs(words, *least), words


def test_long_words_and_texts():
    assert runs.find_runs([b"a"] * 100_000) == [(0, 100_000, 1)]
    assert runs.find_runs([b"x", *[b"a", b"bb"] * 30_000, b"y"]) == [(1, 60_000, 2)]
    fib = [b"a"]
    for k in range(14):
        fib = [w for x in fib for w in ([b"a", b"b"] if x == b"a" else [b"a"])]
    assert runs.find_runs(fib, 2, 3) == plain_runs(fib, 2, 3)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    last = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *last, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_all_periods(spark, sf_dir, given):
    got = {tuple(r) for r in op11_runs(spark, sf_dir).collect()}
    assert got == {expected(r["doc_id"], r["text"]) for r in given[1]}
    assert any(r[1] for r in got)


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    docs = odd_docs.unionByName(spark.createDataFrame([(i, f"w{i % 3} a b c a b c  a\x0bb c a b c a b c x") for i in range(100, 160)], "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op11_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op11_runs(spark, f"{tmp_path}/none").count() == 0
