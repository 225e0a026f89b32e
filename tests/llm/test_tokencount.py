"""Token counts against the library that the vocabulary is made for."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import tokencount
from lectern.llm.queries import op13_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return lambda texts: [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_every_character(library):
    tokens = tokencount.TokenCounter(PATH)
    texts = [f"a{c}b 1{c}2 {c}.{c}  {c}" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    for i in range(0, len(texts), 50_000):
        part = texts[i : i + 50_000]
        assert list(map(tokens, part)) == library(part)


def test_made_up_texts(library, monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 50)  # generations change often
    tokens, rnd = tokencount.TokenCounter(PATH), random.Random(1)
    some = ["<|endoftext|>", "<|endoftext", "'re", "\n\n", "東京", "😀", "é", "Ġ", "  ", "the ", "under"]
    texts = ["".join(rnd.choice([*some, *"abethinr  \n's09.,"]) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    texts += ["z" * 100_000, "".join(rnd.choice("abcdefghij") for _ in range(100_000)), " " * 5000, "!" * 5000]
    assert list(map(tokens, texts)) == library(texts)


def test_query(spark, sf_dir, given, library):
    got = sorted(tuple(r) for r in op13_tokens(spark, sf_dir).collect())
    counts = library([r["text"] or "" for r in given[1]])
    assert got == sorted((r["doc_id"], len((r["text"] or "").encode()), n, n > 1024) for r, n in zip(given[1], counts))


def test_odd_rows(odd_docs, no_docs, library):
    rows = tokencount.count_tokens(odd_docs.withColumnRenamed("n_chars", "n_tokens")).collect()
    assert [r["n_tokens"] for r in rows] == library([r["text"] or "" for r in rows])
    assert len(rows) == 11 and rows[0]["n_bytes"] == 0 and rows[-1]["doc_id"] is None
    assert tokencount.count_tokens(no_docs).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        tokencount.Merges(public_tokenizers.path("word_bpe_49k.json"))
