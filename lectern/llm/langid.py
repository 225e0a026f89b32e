"""Language of texts as a mixture: expectation-maximisation over n-gram likelihoods, set of languages by penalised likelihood.

Letters, lower-cased, with anything else as one space, give character trigrams. Each language has smoothed
likelihoods of hashed trigrams. A text is a mixture of languages, each word drawn from one of them;
expectation-maximisation estimates the proportions. The set of languages starts with the best single one
and grows by the language that raises the likelihood most, while the rise exceeds penalty * log(words).

Likelihoods are learned from a bounded sample: about per_lang rows of each language, chosen by a hash of
doc_id, whole texts. The model is a table of 2**15 rows and one column for each language, however large
the corpus.

Defined results: null, empty and letterless texts are und with score 0; so is any text if nothing could be
learned; of equal proportions the language first in code point order wins; repeated rows are predicted
each; texts of any length are read whole, in blocks of BLOCK code points, at whose ends a word is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_remainder

BUCKETS = 1 << 15
BLOCK = 1 << 18
UNKNOWN = "und"


class Trigrams:
    """Hashed trigrams of a text and the first trigram of each word."""

    def __init__(self) -> None:
        self.letter = np.zeros(0x110000, bool)
        self.letter[:0x32400] = [chr(i).isalpha() for i in range(0x32400)]

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = self.letter[points]
        before = np.concatenate(([False], letter[:-1]))
        kept = np.concatenate(([np.uint32(32)], np.where(letter, points, np.uint32(32))[letter | before], [np.uint32(32)]))
        if len(kept) < 3 or not letter.any():
            return None
        mixed = kept[:-2] * np.uint32(0x9E3779B1) ^ kept[1:-1] * np.uint32(0x85EBCA6B) ^ kept[2:] * np.uint32(0xC2B2AE35)
        mixed ^= mixed >> np.uint32(15)
        within = kept[1:-1] != 32  # a trigram stands for its middle letter
        return (mixed * np.uint32(0x2C1B3C6D) >> np.uint32(17))[within], np.flatnonzero((kept[:-2] == 32)[within])


@dataclass
class LanguageModel:
    langs: list[str]
    logs: np.ndarray  # BUCKETS x langs, log-likelihood of each trigram

    def words(self, text: str, trigrams: Trigrams) -> np.ndarray | None:
        """Log-likelihood of each word in each language."""
        parts = []
        for i in range(0, len(text), BLOCK):
            if (found := trigrams(text[i : i + BLOCK])) is not None:
                parts.append(np.add.reduceat(self.logs[found[0]], found[1], axis=0))
        return np.concatenate(parts) if parts else None

    def mixture(self, words: np.ndarray, penalty: float = 1.5, steps: int = 12) -> tuple[list[int], np.ndarray]:
        """The chosen languages and their proportions."""
        singles = words.sum(0, dtype=np.float64)
        chosen, share = [int(np.argmax(singles))], np.ones(1)
        now, cost = words[:, chosen[0]].astype(np.float64), penalty * np.log(len(words) + 1) + penalty
        while len(chosen) < words.shape[1]:
            best = None
            for other in (k for k in range(words.shape[1]) if k not in chosen):
                if np.maximum(words[:, other] - now, 0).sum() <= cost:
                    continue  # the likelihood cannot rise by more
                trial = [*chosen, other]
                got, level, rise = _maximise(words[:, trial].astype(np.float64), np.append(share * 0.8, 0.2), steps)
                if rise - now.sum() > cost and (best is None or rise > best[0]):
                    best = rise, trial, got, level
            if best is None:
                break
            _, chosen, share, now = best
        return chosen, share

    def predict(self, text: str) -> Column:
        """lang_pred and score of each text of a column, as a struct."""
        model = self

        def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            trigrams = Trigrams()
            for texts in batches:
                out = []
                for t in texts:
                    words = model.words(t, trigrams) if model.langs else None
                    if words is None:
                        out.append((UNKNOWN, 0.0))
                    else:
                        chosen, share = model.mixture(words)
                        top = min(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
                        out.append((model.langs[chosen[top]], float(min(1.0, share[top]))))
                yield pd.DataFrame(out, columns=["lang_pred", "score"])

        return F.pandas_udf(each, "lang_pred string, score double")(F.coalesce(F.col(text), F.lit("")))


def _maximise(words: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Proportions after some steps, each word's log-likelihood under them, and its sum."""
    top = words.max(1, keepdims=True)
    like = np.exp(words - top)
    for _ in range(steps):
        joint = like * share
        new = (joint / joint.sum(1, keepdims=True)).mean(0)
        done, share = np.abs(new - share).max() < 1e-4, new
        if done:
            break
    level = np.log(like @ share) + top[:, 0]
    return share, level, float(level.sum())


def learn_languages(docs: DataFrame, modulus: int = 4, held: int = 2, per_lang: int = 1500, smoothing: float = 0.3) -> LanguageModel:
    """Learns from rows of docs with a language whose id_remainder by modulus is not held."""
    known = docs.filter(F.col("lang").isNotNull()).filter(id_remainder("doc_id", modulus) != held)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    parts = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / counts[k]) * 2**31)])
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(2**31))
    sample = known.filter(place < parts[F.col("lang")]).select("lang", F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trigrams, seen = Trigrams(), {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                total = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for i in range(0, len(text), BLOCK):
                    if (found := trigrams(text[i : i + BLOCK])) is not None:
                        total += np.bincount(found[0], minlength=BUCKETS)
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": total[at]})

    table = sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.full((BUCKETS, len(langs)), smoothing)
    place_of = {k: i for i, k in enumerate(langs)}
    np.add.at(sums, (table["bucket"].to_numpy(), [place_of[k] for k in table["lang"].to_pylist()]), table["n"].to_numpy())
    return LanguageModel(langs, np.log(sums / sums.sum(0)).astype(np.float32))
