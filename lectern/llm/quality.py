"""Quality score of texts from two zstandard dictionaries, one built from good and one from bad labelled text.

A text is compressed whole, in blocks, once with either dictionary. The difference of the compressed sizes
over the text's size, with the ratio and length of the text beside it, becomes a probability through a
logistic calibration that is fitted on labelled rows of which neither dictionary was built.

Labels are learned from a bounded sample: per_class rows of each class (the lowest hashes of doc_id), texts
of at most longest code points. One half builds the dictionaries, the other half calibrates, weighed by how
often its class occurs among all labelled rows.

Defined results: a null text scores as the empty one; labels without a row in docs, or null, teach nothing;
of a doc_id labelled twice the larger label counts; with labels of one class only, or none, every score is
that class's share (0.5 without labels). Repeated rows are scored each; further columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_remainder

#: Bytes that a short text's sizes are thinned by.
PRIOR_BYTES = 48


class Sizes:
    """Compressed sizes of texts, block by block, with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3, block: int = 4096):
        import zstandard as z

        self.block, self.by = block, []
        for content in (good, bad):
            book = z.ZstdCompressionDict(content)
            book.precompute_compress(level)
            self.by.append(z.ZstdCompressor(level=level, dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def __call__(self, text: str) -> tuple[int, int, int]:
        data, (by_good, by_bad) = text.encode("utf-8", "surrogatepass"), self.by
        parts = [data[i : i + self.block] for i in range(0, max(1, len(data)), self.block)]
        return sum(map(len, map(by_good, parts))), sum(map(len, map(by_bad, parts))), len(data)

    def features(self, texts: list[str]) -> np.ndarray:
        good, bad, n = np.array([self(t) for t in texts], float).reshape(-1, 3).T
        n = n + PRIOR_BYTES
        gain, ratio, length = 20 * (bad - good) / n, np.log((good + bad) / 2 / n + 0.01) + 1, (np.log(n) - 7) / 2
        return np.stack([np.ones_like(n), gain, ratio, length, gain * gain, ratio * ratio, gain * ratio, gain * length, ratio * length], 1)


@dataclass
class QualityModel:
    """What the executors get: two dictionaries, or none, and the calibration's weights."""

    good: bytes
    bad: bytes
    weights: list[float]
    share: float

    def scores(self, texts: list[str], sizes: Sizes | None) -> np.ndarray:
        if sizes is None or not texts:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(sizes.features(texts) @ np.array(self.weights), -30, 30)))

    def score(self, text: str) -> Column:
        """Probability of label 1 for the texts of a column."""
        model = self

        def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            sizes = Sizes(model.good, model.bad) if model.good else None
            for texts in batches:
                yield pd.Series(model.scores(texts.tolist(), sizes))

        return F.pandas_udf(each, "double")(F.coalesce(F.col(text), F.lit("")))


def _dictionary(texts: list[str], size: int) -> bytes:
    import zstandard as z

    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    try:
        return z.train_dictionary(size, data, level=3).as_bytes()
    except z.ZstdError:  # too few samples to train on: their own bytes serve
        return b"".join(data)[-size:] or b" " * 8


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression, by damped Newton steps."""
    w, hold = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    hold[0, 0] = 1e-6

    def loss(v: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v)) + v @ hold @ v / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + hold + 1e-9 * np.eye(len(w)), x.T @ (weight * (y - p)) - hold @ w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        if size <= 1e-4 or np.abs(size * step).max() < 1e-6:
            break
        w = w + size * step
    return w


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, per_class: int = 3000, longest: int = 65536, size: int = 65536) -> QualityModel:
    """Learns from rows of labels whose id_remainder by modulus is not held."""
    known = labels.filter(id_remainder("doc_id", modulus) != held).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {int(r["label"]): r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect() if r["label"] in (0, 1)}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    order = F.xxhash64("doc_id"), F.col("doc_id")
    sample: dict[int, list[str]] = {}
    for y in (0, 1):
        few = known.filter(F.col("label") == y).orderBy(*order).limit(per_class).select("doc_id")
        texts = docs.join(F.broadcast(few), "doc_id").filter(F.length("text") <= longest).select("doc_id", "text")
        sample[y] = [r["text"] for r in texts.orderBy(*order, "text").limit(per_class).collect()]
    if min(map(len, sample.values())) < 2:
        return QualityModel(b"", b"", [], share)
    good, bad = (_dictionary(sample[y][::2], size) for y in (1, 0))
    rest = {y: sample[y][1::2] for y in (0, 1)}
    x = Sizes(good, bad).features(rest[0] + rest[1])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    weight = np.repeat([(1 - share) / len(rest[0]), share / len(rest[1])], [len(rest[0]), len(rest[1])]) * len(y)
    return QualityModel(good, bad, _calibrate(x, y, weight).tolist(), share)
