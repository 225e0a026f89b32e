import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import media, queries


@pytest.mark.parametrize("n", [0, 1, 192, 193, 385, 4000, 200_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    payload = data + b" " * (max(192, -(-n // 192) * 192) - n)
    parts, quant, factors, shape, size = media.coefficients(media.encode(payload))
    assert media.payload_in(parts, size) == payload
    assert media.rgb_tensor(parts, quant, factors, shape).shape == (*shape, 3)


def test_query(spark, given, sf_dir):
    rows = {r["doc_id"]: r for r in queries.op4_media(spark, sf_dir).collect()}
    for d in given[1]:
        r, text = rows[d["doc_id"]], (d["text"] or "").encode()
        payload = text + b" " * (max(192, -(-len(text) // 192) * 192) - len(text))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.encode(payload)).hexdigest()


def test_odd_rows(odd_docs, no_docs):
    rows = media.decode_media(media.encode_media(odd_docs)).collect()
    assert len(rows) == 11
    for r in rows:
        rgb = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
        assert media.feature_of(rgb) == r["feature"]
    assert len({(r["media"], r["feature"]) for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert media.decode_media(media.encode_media(no_docs)).count() == 0


# A small progressive encoder of any coefficients, bit by bit, for one grey component: the decoder's general ways.


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def done(self):
        return media._closed(np.array(self.bits, np.uint8))


CODES = (bytes([0] * 8 + [255] + [0] * 7), bytes(range(255)))  # each symbol but the last as its own number in 9 bits


def sized(v):
    return (v if v > 0 else v + (1 << abs(v).bit_length()) - 1), abs(v).bit_length()


def first(blocks, low, high, shift):
    w, ended = Writer(), 0

    def flush(n):
        while n:
            p = min(14, n.bit_length() - 1)
            w.put(p << 4, 9)
            take = min(n, (2 << p) - 1)
            w.put(take - (1 << p), p)
            n -= take

    for b in blocks:
        values = [int(np.sign(v)) * (abs(int(v)) >> shift) for v in b[low : high + 1]]
        run = 0
        last = max((i for i, v in enumerate(values) if v), default=-1)
        if last >= 0:
            flush(ended)
            ended = 0
        for v in values[: last + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                w.put(0xF0, 9)
                run -= 16
            bits, n = sized(v)
            w.put(run << 4 | n, 9)
            w.put(bits, n)
            run = 0
        if last < len(values) - 1:
            ended += 1
    flush(ended)
    return w.done()


def refine(blocks, low, high, shift):
    w = Writer()
    for b in blocks:
        values = [int(v) for v in b[low : high + 1]]
        new = [i for i, v in enumerate(values) if abs(v) >> shift == 1]
        at, run, waiting = 0, 0, []
        last = max(new, default=-1)
        for i, v in enumerate(values[: last + 1]):
            known = abs(v) >> shift > 1
            if known:
                waiting.append(abs(v) >> shift & 1)
            elif i in new:
                w.put(run << 4 | 1, 9)
                w.put(1 if v > 0 else 0, 1)
                w.bits += waiting
                run, waiting = 0, []
            else:
                if run == 15:
                    w.put(0xF0, 9)
                    w.bits += waiting
                    run, waiting = 0, []
                else:
                    run += 1
        rest = [abs(v) >> shift & 1 for v in values[last + 1 :] if abs(v) >> shift > 1]
        if last < len(values) - 1 or not new:
            w.put(0x00, 9)
            w.bits += waiting + rest
    return w.done()


@pytest.mark.parametrize("seed", range(4))
def test_general_scans(seed):
    rng = np.random.default_rng(seed)
    rows, columns = 2, 3
    blocks = np.where(rng.random((rows * columns, 64)) < 0.35, rng.integers(-60, 61, (rows * columns, 64)), 0)
    blocks[2, 1:] = 0
    w, before = Writer(), 0
    for v in blocks[:, 0] >> 1:
        bits, n = sized(int(v) - before) if int(v) != before else (0, 0)
        w.put(n, 9)
        w.put(bits, n)
        before = int(v)
    dc = Writer()
    for v in blocks[:, 0]:
        dc.put(int(v) & 1, 1)
    tables = b"".join(bytes([k]) + CODES[0] + CODES[1] for k in (0x00, 0x10))
    head = bytes([8, 0, 8 * rows, 0, 8 * columns, 1, 1, 0x11, 0])
    out = [b"\xff\xd8", media._segment(0xDB, b"\0" + bytes(range(1, 65))), media._segment(0xC2, head), media._segment(0xC4, tables)]
    one = [(1, 0)]
    out += [media._scan(one, 0, 0, 0, 1), w.done(), media._scan(one, 1, 20, 0, 2), first(blocks, 1, 20, 2), media._scan(one, 21, 63, 0, 0), first(blocks, 21, 63, 0)]
    out += [media._scan(one, 1, 20, 2, 1), refine(blocks, 1, 20, 1), media._scan(one, 1, 20, 1, 0), refine(blocks, 1, 20, 0), media._scan(one, 0, 0, 1, 0), dc.done(), b"\xff\xd9"]
    parts, quant, factors, shape, size = media.coefficients(b"".join(out))
    assert size is None and shape == (16, 24)
    assert np.array_equal(parts[0].reshape(-1, 64), blocks)
    rgb = media.rgb_tensor(parts, quant, factors, shape)
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    square = np.zeros(64)
    square[media.ZIGZAG] = blocks[4] * np.arange(1, 65)
    want = np.clip(np.rint(basis @ square.reshape(8, 8) @ basis.T + 128), 0, 255)
    assert np.abs(rgb[8:16, 8:16, 0] - want).max() <= 1


def test_chroma_is_upsampled():
    parts = [np.zeros((2, 2, 64), np.int32), np.zeros((1, 1, 64), np.int32), np.zeros((1, 1, 64), np.int32)]
    parts[2][0, 0, 0] = 8 * 50
    rgb = media.rgb_tensor(parts, [np.ones(64, np.float32)] * 3, [(2, 2), (1, 1), (1, 1)], (16, 16))
    assert (rgb.reshape(-1, 3) == [198, 92, 128]).all()


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        media.coefficients(b"\xff\xd8" + media._segment(0xC0, bytes(9)) + b"\xff\xd9")


def test_parts_hold_bounded_bytes():
    texts = ["a" * n for n in (3, 3, 9, 20, 1, 0, 0, 0, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = [p.column("text").to_pylist() for p in media._parts(batch, "text", 4, 10)]
    assert sum(parts, []) == texts and [len(p) for p in parts] == [2, 1, 1, 4, 2]
    assert list(media._parts(batch.slice(0, 0), "text")) == []
