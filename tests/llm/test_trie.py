"""Prefix tries of conversations against a plain dictionary of prefixes, and SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lectern.llm import trie
from lectern.llm.queries import OP12, op12_trie


def plain_trie(paths):
    """Nodes of paths, lists of (role, text) by conv_id."""
    members, below = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    for k in members:
        if k:
            below[k[:-1]].append(k)
    out, sums = [], {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves = sum(sums[x][0] for x in below[k]) or 1
        saved = (len(members[k]) - 1) * words + sum(sums[x][1] for x in below[k])
        sums[k] = (leaves, saved)
        ends = ",".join(str(c) for c in sorted(members[k]) if len(paths[c]) == len(k))
        up = min(members[k[:-1]]) if k else None
        out.append((min(members[k]), len(k), up, len(members[k]), len(below[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(rows):
    """Conversations of rows (conv_id, turn, role, text) as the query has them."""
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        if c is not None:
            own[c].append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def nodes(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("shard_turns, capacity", [(10**6, 3), (9, 2), (3, 100)])
@pytest.mark.parametrize("n", [1, 150])
def test_shards_and_bursts(spark, n, shard_turns, capacity):
    rnd, paths = random.Random(n), {}
    for c in range(n):
        paths[c] = [(rnd.choice("ua"), rnd.choice(["x", "y z", "q w e"])) for _ in range(rnd.randint(0, 6))]
        if rnd.random() < 0.3:
            paths[c] = [("u", "x y")] * rnd.randint(0, 9)
    made = [(c, [(hashlib.sha256(repr(t).encode()).hexdigest()[:32], len(t[1].split())) for t in p]) for c, p in paths.items()]
    convs = spark.createDataFrame(made, "conv_id long, turns array<struct<id:string,words:long>>")
    assert nodes(trie.trie_nodes(convs, shard_turns, capacity)) == plain_trie(paths)


def test_one_burst_after_another():
    """Containers of one long common beginning: many heads, no recursion, all rows in order."""
    made, whole = trie.BurstTrie(2), b"".join(bytes([i % 256]) * trie.ID for i in range(3000))
    paths = [whole[: trie.ID * k] for k in random.Random(4).sample(range(1, 3001), 400)]
    for p in paths:
        made.add(p, p)
    assert list(made.in_order()) == sorted(paths)


def test_shared_turns():
    rnd = random.Random(2)
    for _ in range(500):
        a = b"".join(rnd.choice([b"a" * 16, b"b" * 16]) for _ in range(rnd.randint(0, 9)))
        b = a[: 16 * rnd.randint(0, 9)] + b"c" * 16 * rnd.randint(0, 2)
        want = 0
        while a[want * 16 : want * 16 + 16] == b[want * 16 : want * 16 + 16] != b"":
            want += 1
        assert trie.shared_turns(a, b) == want


def test_query(spark, sf_dir, same, duck):
    same(op12_trie(spark, sf_dir), OP12)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(op12_trie(spark, sf_dir)) == plain_trie(rebuilt(rows))


def test_odd_rows(spark, tmp_path):
    rows = [(None, 1, "user", "no id"), (-40, 1, "user", "below zero"), (-41, 2, "user", "x"), (-41, None, None, None), (-41, None, None, None)]
    rows += [(c, t, "user" if t % 2 else "assistant", f"text {t} of\x0bthis" if c % 3 else "") for c in range(300) for t in range(c % 6)]
    rows += [(400 + c, t, "user", "copied") for c in range(90) for t in range(40)]  # a third of all rows
    rows += [(1000, 1, "user", "word " * 50_000), (1019, 1, "user", "alone"), (1020, 7, "a", "u"), (1021, 3, "au", "")]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, n_convs string")
    docs.write.parquet(f"{tmp_path}/conversations.parquet")
    assert nodes(op12_trie(spark, str(tmp_path))) == plain_trie(rebuilt(rows))
    docs.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op12_trie(spark, f"{tmp_path}/none").count() == 0
