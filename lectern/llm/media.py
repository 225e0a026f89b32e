"""Media columns: payloads as progressive JPEG, decoded to full-resolution RGB tensors in numpy.

encode_media stores bytes losslessly in the format's own unit, the quantised coefficient: a byte is the
eight amplitude bits of a coefficient of category 8, so each value from 0 to 255 is one coefficient. The
files have 4:2:0 colour and ten scans: DC and two AC bands without their lowest bit (spectral selection),
then these bits (successive approximation). decode_media accumulates the scans of any Huffman-coded
progressive JPEG of 8-bit samples without restarts into coefficient arrays, inverse-transforms them by one
matrix product, upsamples chroma, converts to RGB, and reads the payload back from the coefficients.

Defined results: null and empty texts are a payload of 192 spaces; equal bytes give equal files, tensors and
features; repeated rows are stored each; an empty table gives an empty result. A file and its tensor (twice
the payload) are made whole, one at a time, in the memory of one task.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, FILL = 192, 32
#: Fixed values of the format: the zigzag order, and the usual DC code lengths and categories.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
DC_CODES = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
#: One symbol: no zeros before, seven amplitude bits. Fifteen symbols: runs of ended blocks.
AC_FIRST_CODES = (bytes([1] + [0] * 15), bytes([0x07]))
AC_REFINE_CODES = (bytes([0, 0, 0, 0, 15] + [0] * 11), bytes(range(0x00, 0xF0, 0x10)))
BANDS = ((1, 5), (6, 63))
MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


@lru_cache(64)
def _codes(lengths: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Code and its length of each symbol."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for s in symbols[at : at + count]:
            out[s] = code, n
            code += 1
        at += count
        code <<= 1
    return out


@lru_cache(64)
def _lookup(lengths: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length (0: none) and symbol for each 16 bits that a stream may go on with."""
    size, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for s, (code, n) in _codes(lengths, symbols).items():
        size[code << (16 - n) : (code + 1) << (16 - n)] = n
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
    return size, symbol


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _closed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes: filled up with ones, stuffed."""
    data = np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))).tobytes()
    return data.replace(b"\xff", b"\xff\x00")


def _scan(components: list[tuple[int, int]], low: int, high: int, before: int, after: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in c), low, high, before << 4 | after]))


def _mcu_order(across: int, down: int) -> np.ndarray:
    """Places of the blocks, luma then both chromas, in the order of an interleaved scan."""
    n = across * down
    luma = np.arange(4 * n).reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(n, 4)
    return np.concatenate((luma, 4 * n + np.arange(n)[:, None], 5 * n + np.arange(n)[:, None]), 1)


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes([FILL]) * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds payload, a positive multiple of UNIT bytes, in its coefficients."""
    units = -(-len(payload) // 384)
    down = -(-units // 1024)
    across = -(-units // down)
    n = across * down
    data = np.frombuffer(payload.ljust(384 * n, b"\0"), np.uint8).reshape(6 * n, 64)
    last = (data & 1) ^ (data < 128)
    parts = {1: slice(0, 4 * n), 2: slice(4 * n, 5 * n), 3: slice(5 * n, 6 * n)}
    head = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = b"".join(bytes([kind]) + lengths + symbols for kind, (lengths, symbols) in ((0x00, DC_CODES), (0x10, AC_FIRST_CODES), (0x11, AC_REFINE_CODES)))
    out = [b"\xff\xd8", _segment(0xFE, b"bytes " + str(len(payload)).encode()), _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC2, head), _segment(0xC4, tables)]
    order = _mcu_order(across, down)
    dc = data[:, 0].astype(np.int32)
    dc = np.where(dc < 128, dc - 255, dc) >> 1
    diff = np.empty(6 * n, np.int32)
    for part in (order[:, :4].ravel(), order[:, 4], order[:, 5]):
        diff[part] = np.diff(dc[part], prepend=0)
    diff = diff[order.ravel()]
    category = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int32)
    codes = np.array([_codes(*DC_CODES)[c] for c in range(12)])
    value = codes[category, 0] << category | np.where(diff < 0, diff + (1 << category) - 1, diff)
    size = codes[category, 1] + category
    place = size[:, None] - 1 - np.arange(size.max())
    out += [_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1), _closed((value[:, None] >> np.maximum(place, 0) & 1)[place >= 0].astype(np.uint8))]
    for low, high in BANDS:  # the one code, a zero bit, and seven amplitude bits: a byte below 128
        for c, part in parts.items():
            out += [_scan([(c, 0)], low, high, 0, 1), (data[part, low : high + 1] >> 1).tobytes()]
    out += [_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0), _closed(last[order.ravel(), 0])]
    for c, part in parts.items():
        bits = []
        for at in range(part.start, part.stop, 32767):
            run = min(32767, part.stop - at)
            power = run.bit_length() - 1
            bits.append(np.array([int(b) for b in f"{_codes(*AC_REFINE_CODES)[power << 4][0]:05b}" + f"{run - (1 << power):0{power}b}" * (power > 0)], np.uint8))
            bits.append(last[at : at + run, 1:].ravel())
        out += [_scan([(c, 1)], 1, 63, 1, 0), _closed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


class Bits:
    """An entropy-coded segment."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.at = 0

    @property
    def bits(self) -> np.ndarray:
        if not hasattr(self, "_bits"):
            self._bits = np.concatenate((np.unpackbits(np.frombuffer(self.data, np.uint8)), np.ones(64, np.uint8)))
        return self._bits

    @property
    def windows(self) -> np.ndarray:
        """The 16 bits from each place on."""
        if not hasattr(self, "_windows"):
            raw = np.frombuffer(self.data + b"\xff" * 4, np.uint8).astype(np.uint32)
            wide = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
            self._windows = (wide[:, None] >> np.arange(8, 0, -1, dtype=np.uint32) & 0xFFFF).ravel()
        return self._windows

    def window(self) -> int:
        """The next 16 bits."""
        byte, bit = divmod(self.at, 8)
        return int.from_bytes(self.data[byte : byte + 3].ljust(3, b"\xff"), "big") >> (8 - bit) & 0xFFFF

    def take(self, n: int) -> int:
        value = self.window() >> (16 - n) if n else 0
        self.at += n
        return value

    def symbol(self, table: tuple[np.ndarray, np.ndarray]) -> int:
        window = self.window()
        if not table[0][window]:
            raise ValueError("no such code")
        self.at += int(table[0][window])
        return int(table[1][window])


def _extend(value: np.ndarray | int, size: np.ndarray | int) -> np.ndarray:
    return np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)


def _dc_first(stream: Bits, blocks: int, table: tuple[bytes, bytes]) -> np.ndarray:
    """Differences in scan order: step lengths are known at each bit, so that only they are followed one by one."""
    sizes, symbols = (x[stream.windows] for x in _lookup(*table))
    steps = (sizes.astype(np.int64) + symbols).tolist()
    starts, at = [], 0
    for _ in range(blocks):
        starts.append(at)
        at += steps[at]
    place = np.array(starts)
    category = symbols[place].astype(np.int64)
    amplitude = stream.windows[place + sizes[place]].astype(np.int64) >> (16 - category)
    return np.where(category > 0, _extend(amplitude, category), 0)


def _ac_first(stream: Bits, coefs: np.ndarray, low: int, high: int, shift: int, table: tuple[bytes, bytes]) -> None:
    width = high - low + 1
    if len(table[1]) == 1 and table[1][0] >> 4 == 0 and table[1][0]:  # one symbol: each coefficient has the same place
        code, size = next(i for i, n in enumerate(table[0], 1) if n), table[1][0]
        n = len(coefs) * width
        if code + size == 8:
            value = np.frombuffer(stream.data, np.uint8, n).astype(np.int32) & ((1 << size) - 1)
        else:
            value = stream.bits[: n * (code + size)].reshape(n, -1)[:, code:] @ (1 << np.arange(size - 1, -1, -1))
        coefs[:, low : high + 1] = (_extend(value, size) << shift).reshape(-1, width)
        return
    lookup, ended = _lookup(*table), 0
    for block in coefs:
        if ended:
            ended -= 1
            continue
        k = low
        while k <= high:
            run, size = divmod(stream.symbol(lookup), 16)
            if size:
                k += run
                block[k] = int(_extend(stream.take(size), size)) << shift
                k += 1
            elif run == 15:
                k += 16
            else:
                ended = (1 << run) + stream.take(run) - 1
                break


def _correct(block: np.ndarray, bits: np.ndarray, shift: int) -> None:
    """Adds one more bit to coefficients that are not zero, in place; block is a selection's copy."""
    block += np.sign(block) * (bits.astype(block.dtype) << shift)


def _ac_refine(stream: Bits, coefs: np.ndarray, low: int, high: int, shift: int, table: tuple[bytes, bytes]) -> None:
    lookup, i = _lookup(*table), 0
    while i < len(coefs):
        block, k, ended = coefs[i], low, 0
        while k <= high:
            run, size = divmod(stream.symbol(lookup), 16)
            if not size and run < 15:
                ended = (1 << run) + stream.take(run)
                break
            value = (1 if stream.take(1) else -1) << shift if size else 0
            while k <= high:
                if block[k]:
                    if stream.take(1):
                        block[k] += np.sign(block[k]) * (1 << shift)
                elif run == 0:
                    block[k] = value
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if ended:  # the rest of this block and the next ones have correction bits only
            for rows, first in ((coefs[i : i + 1], k), (coefs[i + 1 : i + ended], low)):
                part = rows[:, first : high + 1]
                known = part != 0
                n = int(known.sum())
                values = part[known]
                _correct(values, stream.bits[stream.at : stream.at + n], shift)
                part[known] = values
                stream.at += n
        i += max(1, ended)


def coefficients(media: bytes) -> tuple[list[np.ndarray], list[np.ndarray], list[tuple[int, int]], tuple[int, int], int | None]:
    """Coefficient arrays (rows, columns, 64 in zigzag order) of all components after all scans, their quantisation
    tables and sampling factors, height and width, and the payload's size where the comment tells it."""
    tables: dict[int, tuple[bytes, bytes]] = {}
    quant: dict[int, np.ndarray] = {}
    parts: dict[int, np.ndarray] = {}
    factors: dict[int, tuple[int, int]] = {}
    chosen: dict[int, int] = {}
    at, size, height, width = 2, None, 0, 0
    while media[at + 1] != 0xD9:
        marker, length = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE and body.startswith(b"bytes "):
            size = int(body[6:])
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC2:
            height, width = struct.unpack_from(">HH", body, 1)
            for i in range(body[5]):
                name, factor, table = body[6 + 3 * i : 9 + 3 * i]
                factors[name], chosen[name] = (factor >> 4, factor & 15), table
            most = max(h for h, _ in factors.values()), max(v for _, v in factors.values())
            across, down = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
            parts = {c: np.zeros((down * v, across * h, 64), np.int32) for c, (h, v) in factors.items()}
        elif marker in (0xC0, 0xC1) or 0xC3 <= marker <= 0xCF or marker == 0xDD and body != b"\0\0":
            raise ValueError("not a Huffman-coded progressive JPEG without restarts")
        elif marker == 0xDA:
            names = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            low, high, bits = body[-3:]
            end = MARKER.search(media, at).start()
            stream, shift = Bits(media[at:end]), bits & 15
            at = end
            if low == 0:
                _dc_scan(stream, names, parts, factors, tables, bits >> 4, shift)
            else:
                (c, t), (h, v) = names[0], factors[names[0][0]]
                own = parts[c][: -(-height * v // (8 * most[1])), : -(-width * h // (8 * most[0]))]
                flat = np.ascontiguousarray(own).reshape(-1, 64)
                (_ac_refine if bits >> 4 else _ac_first)(stream, flat, low, high, shift, tables[0x10 | t & 15])
                own[...] = flat.reshape(own.shape)
    order = list(parts)
    return [parts[c] for c in order], [quant[chosen[c]] for c in order], [factors[c] for c in order], (height, width), size


def _dc_scan(stream: Bits, names: list, parts: dict, factors: dict, tables: dict, refine: int, shift: int) -> None:
    """One DC scan: blocks in the order of minimum coded units if several components take part, else in rows."""
    places = []
    for c, _ in names:
        (h, v), (rows, columns) = factors[c] if len(names) > 1 else (1, 1), parts[c].shape[:2]
        places.append(np.arange(rows * columns).reshape(rows // v, v, columns // h, h).transpose(0, 2, 1, 3).reshape(-1, h * v))
    units, widths = len(places[0]), [p.shape[1] for p in places]
    if refine:
        got = stream.bits[: units * sum(widths)].astype(np.int32).reshape(units, -1)
    elif len({t >> 4 for _, t in names}) > 1:
        raise ValueError("one DC table a scan is read")
    else:
        got = _dc_first(stream, units * sum(widths), tables[names[0][1] >> 4]).reshape(units, -1)
    at = 0
    for (c, _), place, n in zip(names, places, widths):
        own = got[:, at : at + n].ravel()
        flat = parts[c].reshape(-1, 64)
        if refine:
            flat[place.ravel(), 0] |= own << shift
        else:
            flat[place.ravel(), 0] = np.cumsum(own) << shift
        at += n


@lru_cache(1)
def _inverse() -> np.ndarray:
    """64 coefficients in zigzag order to 64 samples."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.kron(one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


def rgb_tensor(parts: list[np.ndarray], quant: list[np.ndarray], factors: list[tuple[int, int]], shape: tuple[int, int]) -> np.ndarray:
    """Height x width x 3 samples: inverse transform, chroma upsampled by repetition, colour conversion."""
    most = max(h for h, _ in factors), max(v for _, v in factors)
    planes = []
    for part, q, (h, v) in zip(parts, quant, factors):
        rows, columns = part.shape[:2]
        samples = (part.reshape(-1, 64).astype(np.float32) * q) @ _inverse()
        plane = np.clip(np.rint(samples + 128), 0, 255).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
        planes.append(plane.repeat(most[1] // v, 0).repeat(most[0] // h, 1)[: shape[0], : shape[1]])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[..., None], 3, 2)
    y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*shape, 3), np.float32)
    out[..., 0] = y + np.float32(1.402) * red
    out[..., 1] = y - np.float32(0.344136) * blue - np.float32(0.714136) * red
    out[..., 2] = y + np.float32(1.772) * blue
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def payload_in(parts: list[np.ndarray], size: int) -> bytes:
    """The bytes that encode has put into the coefficients."""
    flat = np.concatenate([p.reshape(-1) for p in parts])[:size]
    return np.where(flat < 0, flat + 255, flat).astype(np.uint8).tobytes()


def feature_of(rgb: np.ndarray) -> str:
    """Width, height and the sums of each colour's samples."""
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ",".join(map(str, rgb.reshape(-1, 3).sum(0, dtype=np.int64).tolist()))


def _parts(batch: pa.RecordBatch, column: str, rows: int = 512, held: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most so many rows and bytes of a column, by which files and tensors grow; a longer value stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > held or i - start == rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if sizes:
        yield batch.slice(start)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the JPEG file, of each row's text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "text"):
                texts = part.column("text").to_pylist()
                files = pa.array([encode(payload_of(t)) for t in texts], pa.binary())
                sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, files], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, "doc_id long, n_bytes long, media binary")


def decode_media(files: DataFrame, tensors: bool = True) -> DataFrame:
    """files (doc_id, n_bytes, media) with payload, height, width, feature and, with tensors, rgb (rows, columns, colours)."""
    schema = "doc_id long, n_bytes long, media binary, payload binary, height int, width int, feature string, rgb binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "media"):
                payloads, shapes, features, rgbs = [], [], [], []
                for media in part.column("media").to_pylist():
                    parts, quant, factors, shape, size = coefficients(media)
                    rgb = rgb_tensor(parts, quant, factors, shape)
                    payloads.append(payload_in(parts, size) if size is not None else None)
                    shapes.append(shape)
                    features.append(feature_of(rgb))
                    rgbs.append(rgb.tobytes() if tensors else None)
                made = [pa.array(payloads, pa.binary()), pa.array([h for h, _ in shapes], pa.int32()), pa.array([w for _, w in shapes], pa.int32()), pa.array(features), pa.array(rgbs, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *made], ["doc_id", "n_bytes", "media", "payload", "height", "width", "feature", "rgb"])

    return files.select("doc_id", "n_bytes", "media").mapInArrow(each, schema)
