import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given as over
from hypothesis import settings
from hypothesis import strategies as st

from lectern.llm import packing


def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path())


@pytest.fixture(scope="module")
def words():
    return packing.WordEncoder(path())


def ids(tokenizer, text):
    return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(deadline=None, max_examples=300)
@over(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA'sé́ ÉΣß\x1c\x85 İ²½<|")), max_size=60))
def test_words_encode_as_whole_texts(tokenizer, words, text):
    assert list(words([text])) == [ids(tokenizer, text)]


def test_special_and_mixed(tokenizer, words):
    texts = ["it's I'LL we'd''s", "<|endoftext|>x <|ENDOFTEXT|>", "ÀÉ́ x—y…z", "a\x1cb\x0bc", "", "²³ x2y ½"]
    assert list(words(texts)) == [ids(tokenizer, t) for t in texts]


def check(rows, pieces, capacity):
    held, seen = defaultdict(list), defaultdict(int)
    for r in rows:
        assert 0 < r["length"] <= capacity
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert dict(seen) == pieces
    return len(held)


def expected(tokenizer, docs, capacity):
    pieces = defaultdict(int)
    for d in docs:
        data = ids(tokenizer, d["text"] or "") + np.asarray([1], "<u4").tobytes()
        for i, a in enumerate(range(0, len(data), 4 * capacity)):
            part = data[a : a + 4 * capacity]
            pieces[(d["doc_id"], i, i * capacity, len(part) // 4, zlib.crc32(part))] += 1
    return dict(pieces)


def test_all_documents(given, tokenizer):
    docs, rows = given
    got = packing.pack_documents(docs).collect()
    bins = check(got, expected(tokenizer, rows, 4096), 4096)
    least = -(-sum(r["length"] for r in got) // 4096)
    assert bins <= 1.03 * least + 1


def test_odd_rows_and_small_groups(odd_docs, tokenizer):
    pieces = packing.tokenize_pieces(odd_docs, capacity=64)
    got = packing.pack_pieces(pieces, capacity=64, group_size=50, again=3).collect()
    check(got, expected(tokenizer, odd_docs.collect(), 64), 64)


def test_empty(no_docs):
    got = packing.pack_documents(no_docs)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() == 0


def brute(lengths, capacity):
    """Sum of squares, all gaps tried for each piece."""
    bins, where = [], []
    for size in sorted(lengths, reverse=True):
        def cost(gaps):
            counts = defaultdict(int)
            for g in gaps:
                if g:
                    counts[g] += 1
            return sum(c * c for c in counts.values())

        options = []
        for i, used in enumerate(bins):
            if capacity - used >= size:
                options.append((cost([capacity - u - (size if j == i else 0) for j, u in enumerate(bins)]), capacity - used, i))
        options.append((cost([capacity - u for u in bins] + [capacity - size]), capacity + 1, len(bins)))
        _, _, i = min(options, key=lambda o: (o[0], o[1]))
        if i == len(bins):
            bins.append(0)
        bins[i] += size
        where.append(i)
    return sorted(bins)


@settings(deadline=None, max_examples=80)
@over(st.lists(st.integers(1, 16), max_size=25))
def test_sum_of_squares_is_the_smallest(lengths):
    got, offsets = packing.sum_of_squares(np.array(lengths, np.int64), 16)
    used = np.bincount(got, weights=lengths).astype(int).tolist() if lengths else []
    assert sorted(used) == brute(lengths, 16)
