"""Speech segments: fillers, paragraphs, term correction."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.functions.search import automaton
from lectern.operators.fold import fold_in_chunks


def drop_fillers(segments: DataFrame) -> DataFrame:
    """Segments with normalised text, without empty ones and fillers."""
    return segments.withColumn("text", T.normalize_text("text")).filter(~T.is_filler("text"))


def dropped_fillers(segments: DataFrame) -> DataFrame:
    """video_id, kept, dropped."""
    filler = T.is_filler(T.normalize_text("text"))
    return segments.groupBy("video_id").agg(F.count_if(~filler).alias("kept"), F.count_if(filler).alias("dropped"))


class Paragraphs:
    """Open paragraph of one video; it closes after a pause, when long, or at a sentence's end when long enough."""

    def __init__(self, video_id: Any, max_len: int, min_sentence: int, gap: float):
        self.video_id, self.max_len, self.min_sentence, self.gap = video_id, max_len, min_sentence, gap
        self.index, self.open = 0, None

    def close(self) -> dict[str, Any]:
        start, end, parts = self.open
        self.open, self.index = None, self.index + 1
        return {"video_id": self.video_id, "para_idx": self.index - 1, "start": start, "end": end, "text": "".join(parts).strip()}

    def step(self, row: dict[str, Any]) -> list[dict[str, Any]]:
        if self.open is None:
            self.open, self.length = [row["start"], row["end"], [row["text"]]], len(row["text"])
            return []
        pause = row["start"] - self.open[1]
        self.open[1] = row["end"]
        self.open[2].append(row["text"])
        self.length += len(row["text"])
        ended = row["text"][-1:] in fixed.SENTENCE_ENDS and self.length >= self.min_sentence
        return [self.close()] if pause > self.gap or self.length >= self.max_len or ended else []

    def end(self) -> list[dict[str, Any]]:
        return [self.close()] if self.open else []

    def state(self) -> Any:
        return self.open and [*self.open[:2], "".join(self.open[2])]

    def resume(self, state: Any) -> None:
        self.open = state and [*state[:2], [state[2]]]
        self.length = len(state[2]) if state else 0


def to_paragraphs(segments: DataFrame, max_len: int = 200, min_sentence: int = 110, gap: float = 0.9, chunk: int = 16384) -> DataFrame:
    """video_id, para_idx, start, end, text, t of the paragraphs that segments merge into; chunk: segments of a video in one task."""
    kept = drop_fillers(segments).select("video_id", "seq", "start", "end", "text")
    schema = "video_id string, para_idx int, start double, end double, text string"
    made = fold_in_chunks(kept, "video_id", ["seq"], lambda v: Paragraphs(v, max_len, min_sentence, gap), schema, "para_idx", chunk)
    return made.withColumn("t", T.hms("start"))


class Corrector:
    """A term list: which of its terms a text holds is found at once, and only those are applied, in order."""

    def __init__(self, terms: list[tuple[str, str]]):
        self.terms = terms
        self.places: dict[str, list[int]] = {}
        for place, (term, _) in enumerate(terms):
            self.places.setdefault(term.casefold(), []).append(place)
        self.patterns: dict[int, re.Pattern] = {}
        names = [n for n in self.places if n]
        self.names, self.find = names, automaton(names).iter if names else None

    def _pattern(self, place: int) -> re.Pattern:
        """A Latin term may not stand inside a longer Latin word, any other matches as it is; compiled when first met."""
        if place not in self.patterns:
            term = self.terms[place][0]
            latin = re.fullmatch(r"[A-Za-z0-9 ._\-]+", term)
            before, after = ("(?<![A-Za-z0-9])", "(?![A-Za-z0-9])") if latin else ("", "")
            self.patterns[place] = re.compile(before + re.escape(term) + after, re.I)
        return self.patterns[place]

    def _held(self, text: str, after: int) -> list[int]:
        found = {i for _, i in self.find(text.casefold())}
        return sorted(p for i in found for p in self.places[self.names[i]] if p > after)

    def __call__(self, text: str) -> tuple[str, int]:
        """The corrected text and the number of corrections; a term sees what those before it have made."""
        hits, waiting = 0, self._held(text, -1) if self.find else []
        while waiting:
            place = waiting.pop(0)
            by = self.terms[place][1]
            text, n = self._pattern(place).subn(lambda m: by, text)
            if n:
                hits += n
                waiting = self._held(text, place)
        return text, hits


def apply_terms(rows: DataFrame, terms: DataFrame, most_terms: int = 10_000) -> DataFrame:
    """rows with corrected text and hits, the number of corrections. terms: ord, term, replacement, applied in order.

    The term list is brought to the driver and to each task; a list beyond most_terms is refused. A null text stays; a term without
    text or replacement is left out.
    """
    listed = terms.filter("term <> '' AND replacement IS NOT NULL").select("ord", "term", "replacement").limit(most_terms + 1).collect()
    if len(listed) > most_terms:
        raise ValueError(f"more than {most_terms} terms")
    ordered = [(r["term"], r["replacement"]) for r in sorted(listed, key=lambda r: r["ord"])]

    def correct(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        corrector = Corrector(ordered)
        for texts in batches:
            yield pd.DataFrame([(None, 0) if t is None else corrector(t) for t in texts], columns=["text", "hits"])

    fixed_ = rows.withColumn("fixed_", F.pandas_udf(correct, "text string, hits int")("text"))
    names = [c for c in rows.columns if c != "text"]
    return fixed_.select(*names, F.col("fixed_.text").alias("text"), F.col("fixed_.hits").alias("hits"))


def clean_stats(segments: DataFrame, corrected: DataFrame) -> DataFrame:
    """video_id, paragraphs, chars, dropped, term_hits."""
    sums = corrected.groupBy("video_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"), F.sum("hits").alias("term_hits"))
    every = dropped_fillers(segments).select("video_id", "dropped").join(sums, "video_id", "left")
    return every.select("video_id", "dropped", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("paragraphs", "chars", "term_hits")])
