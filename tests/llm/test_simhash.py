import random

import pytest
import xxhash

from lectern.llm import simhash
from lectern.llm.components import connected_components


def brute_fingerprint(text):
    data = (text or "").encode()
    for big in range(65, 91):
        data = data.replace(bytes([big]), bytes([big + 32]))
    words = [w for w in data.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                root[find(a)] = find(b)
    out = {}
    for f in fps:
        out.setdefault(find(f), set()).add(f)
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def components(docs):
    prints = [(d["doc_id"], signed(brute_fingerprint(d["text"]))) for d in docs]
    of = {f: k for k, fs in groups([f for _, f in prints]).items() for f in fs}
    least = {}
    for i, f in prints:
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    return sorted(((i, f, least.get(of[f])) for i, f in prints), key=str)


@pytest.mark.parametrize("docs", ["given", "odd_docs"])
def test_whole_table(docs, request):
    fixture = request.getfixturevalue(docs)
    df, rows = fixture if docs == "given" else (fixture, fixture.collect())
    got = sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == components(rows)


@pytest.mark.parametrize("crowd", [1, 48])
def test_clusters(spark, crowd):
    random.seed(crowd)
    fps = {0, 7, signed(2**63 + 1)} | {signed(random.getrandbits(64)) for _ in range(40)}
    for _ in range(4):
        base = random.getrandbits(64)
        for _ in range(30):
            x = base
            for _ in range(random.randint(0, 5)):
                x ^= 1 << random.randrange(64)
            fps.add(signed(x))
    found = {}
    for r in simhash.near_components(spark.createDataFrame([(f,) for f in fps], "fp long"), crowd).collect():
        found.setdefault(r["root"], set()).add(r["fp"])
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups(fps).values() if len(g) > 1)


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (601, 600)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {600: 600, 601: 600}
