"""Decoration of slides: what stands on so many frames of a video that it is no content, and frames' text without it.

Frames are dealt by video and chunk, a stretch of their index, so that a very long video is many groups. A chunk's items are counted
in one pass over its texts. An item that is frequent enough in a video is so in one of its chunks at least, so only
those can be decoration; where a video has several chunks, a second pass counts just them, by one
automaton a video. Cleaning streams a video's decoration before each of its chunks: no join holds text.

Where a video comes as one row and is of usual length, it is counted, cleaned and folded by itself, in one pass: no text is dealt.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from lectern.functions import fixed
from lectern.functions.search import automaton
from lectern.operators.fold import Fold
from lectern.sources.stages import keep

#: White space of any script, as (?U)\s has it in the expressions of functions.text.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
HAN_FIRST, HAN_LAST = "\u4e00", "\u9fff"
HAN = f"{HAN_FIRST}-{HAN_LAST}"
HAN_SIGN, HAN_RUN = re.compile(f"[{HAN}]"), re.compile(f"[{HAN}]+")
ALONE = re.compile(f"(?<![^{SPACE}])[{HAN}](?![^{SPACE}])")
LATIN_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_\-]*")
WHOLE_RUN = re.compile(rf"([{HAN}]+|[A-Za-z][A-Za-z0-9_\-/.]*|\d+)")
PAGE = regex.compile(rf"(?<![\p{{L}}\p{{N}}\p{{M}}_])[0-9]{{1,3}}[{SPACE}]*/[{SPACE}]*[0-9]{{1,3}}(?![\p{{L}}\p{{N}}\p{{M}}_])")
SIGNS = re.compile("[&§@#]+")
SPACES = re.compile(f"[{SPACE}]+")
#: Kinds of items: Latin words and n-grams count once a frame, characters standing alone each time.
KINDS = ("word", "gram", "alone")
NEARLY = 1 - 1e-9  # a chunk's share may miss the ratio by rounding alone

ITEMS = "array<struct<kind:string,item:string,seen:long>>"
FLUSH, FLUSH_CHARS = 1 << 16, 1 << 20
#: Entries that a table of counts may have besides four a sign.
TABLE = 1 << 15
#: Items that are taken out of a text one by one.
FEW = 512
#: Frames and characters that a video has at most to be counted and cleaned by itself.
WHOLE_FRAMES, WHOLE_CHARS = 4096, 1 << 20


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[Any, Any], list[str]]]:
    """Video and chunk with their texts, of rows that are sorted by them."""
    now, texts = None, []
    for batch in batches:
        for video, chunk, text in zip(*(batch.column(c).to_pylist() for c in ("video_id", "chunk_", "text"))):
            if (video, chunk) != now:
                if texts:
                    yield now, texts
                now, texts = (video, chunk), []
            texts.append(text)
    if texts:
        yield now, texts


def _dense(codes: np.ndarray, below: int, room: int) -> tuple[np.ndarray, int]:
    """Codes, all under a bound, as numbers from 0 without gaps, and how many there are; by a table where it has room."""
    if below > room:
        found, numbers = np.unique(codes, return_inverse=True)
        return numbers, len(found)
    there = np.zeros(below + 1, np.int64)
    there[codes + 1] = 1
    place = np.cumsum(there)
    return place[codes], int(place[-1])


class ChunkCounter:
    """Counts of the items of one chunk's texts that reach their ratio in it."""

    def __init__(self, ratio: float = 0.4, gram_ratio: float = 0.6, gram_min: int = 2, isolated_ratio: float = 0.3, gram_max: int = 8):
        self.ratios, self.least, self.most = {"word": ratio, "gram": gram_ratio, "alone": isolated_ratio}, gram_min, gram_max

    def _reach(self, counts: Counter, kind: str, n: int) -> dict[str, int]:
        needed = n * self.ratios[kind] * NEARLY
        return {item: seen for item, seen in counts.items() if seen >= needed}

    def _grams(self, texts: list[str]) -> dict[str, int]:
        """n-grams by length: one is looked at where the two that it holds, each shorter by one, reach the ratio.

        All texts are one array of signs, and grams of one length one array of numbers. Numbers are dense, so that they are mostly counted by
        tables and only where these would be much larger than the text by sorting.
        """
        whole, n = "\n".join(texts), len(texts)
        signs = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        signs = np.r_[np.where((signs >= ord(HAN_FIRST)) & (signs <= ord(HAN_LAST)), signs - ord(HAN_FIRST), -1), -1]
        frame = np.repeat(np.arange(n), [len(t) + 1 for t in texts])
        found, starts, needed = {}, np.flatnonzero(signs >= 0), n * self.ratios["gram"] * NEARLY
        room = 4 * len(signs) + TABLE
        # signs by the number of the chunk's own, and grams at each place by that of the grams of their length
        signs[starts], kinds = _dense(signs[starts], ord(HAN_LAST) - ord(HAN_FIRST) + 1, room)
        number, grams = signs.copy(), kinds
        for size in range(1, self.most + 1):
            if size > 1:
                alive = np.zeros(len(signs) + 1, bool)
                alive[starts] = True
                starts = starts[alive[starts + 1]]
                number[starts], grams = _dense(number[starts] * kinds + signs[starts + size - 1], grams * kinds, room)
            if not len(starts):
                break
            if size >= self.least:
                now = number[starts]
                in_frames = now * n + frame[starts]
                if grams * n <= room:
                    met = np.zeros(grams * n, bool)
                    met[in_frames] = True
                    seen = np.count_nonzero(met.reshape(grams, n), axis=1)
                else:
                    seen = np.bincount(np.unique(in_frames) // n, minlength=grams)
                often = seen >= needed
                first = np.zeros(grams, np.int64)
                first[now] = starts
                found |= {whole[i : i + size]: c for i, c in zip(first[often].tolist(), seen[often].tolist())}
                starts = starts[often[now]]
        return found

    def __call__(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """kind, item and count."""
        words, alone = Counter(), Counter()
        for t in texts:
            words.update(set(LATIN_WORD.findall(t)))
            alone.update(ALONE.findall(t))
        n = len(texts)
        found = {"word": self._reach(words, "word", n), "gram": self._grams(texts), "alone": self._reach(alone, "alone", n)}
        return [(kind, item, seen) for kind in KINDS for item, seen in found[kind].items()]


def _count_again(items: list[dict[str, Any]], texts: list[str]) -> Counter:
    """How often each of items (kind, item) stands in a chunk's texts."""
    by_kind = {kind: [x["item"] for x in items if x["kind"] == kind] for kind in KINDS}
    words, alone, counts = set(by_kind["word"]), set(by_kind["alone"]), Counter()
    grams = automaton(by_kind["gram"]) if by_kind["gram"] else None
    for t in texts:
        counts.update(("word", w) for w in words.intersection(LATIN_WORD.findall(t)))
        counts.update(("alone", c) for c in ALONE.findall(t) if c in alone)
        if grams:
            counts.update(("gram", by_kind["gram"][i]) for i in {i for _, i in grams.iter(t)})
    return counts


def _found_in_chunks(dealt: DataFrame, counter: ChunkCounter) -> DataFrame:
    """video_id, chunk_, n, items of each chunk of texts dealt by video and chunk."""
    schema = f"video_id string, chunk_ long, n long, items {ITEMS}"
    names = ["video_id", "chunk_", "n", "items"]

    def batch_of(rows: list[tuple[Any, Any, int, list[tuple[str, str, int]]]]) -> pa.RecordBatch:
        flat = [x for r in rows for x in r[3]]
        ends = list(itertools.accumulate((len(r[3]) for r in rows), initial=0))
        columns = [pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
        items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["kind", "item", "seen"]))
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))), items], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for (video, part), texts in _groups(batches):
            rows.append((video, part, len(texts), counter(texts)))
            size += 16 + len(rows[-1][3])
            if size > FLUSH:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)

    return dealt.mapInArrow(count, schema)


def _decoration(frames: DataFrame, chunk: int, **ratios: Any) -> tuple[DataFrame, DataFrame]:
    """The chunks (video_id, chunk_) of frames, and video_id, chrome."""
    counter = ChunkCounter(**ratios)
    texts = frames.select("video_id", F.floor(F.col("index") / chunk).alias("chunk_"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.repartition("video_id", "chunk_").sortWithinPartitions("video_id", "chunk_")
    local = keep(_found_in_chunks(dealt, counter))
    videos = local.groupBy("video_id").agg(F.sum("n").alias("frames"), F.count("*").alias("chunks"))
    needed = F.create_map(*[F.lit(x) for pair in counter.ratios.items() for x in pair])
    # of one chunk, what it has counted is the video's count
    reached = F.filter("items", lambda x: x["seen"] >= F.col("frames") * needed[x["kind"]])
    found = local.join(videos.filter("chunks = 1"), "video_id").select("video_id", reached.alias("items"))
    long = videos.filter("chunks > 1")
    if not long.isEmpty():
        met = _met_again(texts, local.join(long, "video_id")).groupBy("video_id", "kind", "item").agg(F.sum("seen").alias("seen"))
        often = met.join(videos, "video_id").filter(F.col("seen") >= F.col("frames") * needed[F.col("kind")])
        gathered = often.groupBy("video_id").agg(F.collect_list(F.struct("kind", "item", "seen")).alias("items"))
        found = found.unionByName(long.select("video_id").join(gathered, "video_id", "left"))
    usual = F.array(*map(F.lit, fixed.CHROME_WORDS))
    named = F.transform("items", lambda x: F.when(x["kind"] == "word", F.lower(x["item"])).otherwise(x["item"]))
    every = F.sort_array(F.array_distinct(F.concat(usual, F.coalesce(named, F.array().cast("array<string>")))))
    return local.select("video_id", "chunk_"), found.select("video_id", every.alias("chrome"))


def detect_chrome(frames: DataFrame, chunk: int = 256, **ratios: Any) -> DataFrame:
    """video_id, chrome: for each video the items that stand on so many of its frames, and the usual ones.

    Items are Latin words (ratio, 0.4 of the frames), n-grams of Han characters of gram_min (2) to gram_max (8; gram_ratio, 0.6),
    and Han characters standing alone (isolated_ratio, 0.3, counted each time). chunk: indices counted together.
    """
    return _decoration(frames, chunk, **ratios)[1]


def _told(texts: DataFrame, named: DataFrame, column: str, *order: str) -> DataFrame:
    """texts with a row of named (video_id, chunk_, column) before the rows of each video and chunk, dealt by them."""
    first = F.col(column).isNull()  # false comes before true
    both = texts.unionByName(named, allowMissingColumns=True)
    return both.repartition("video_id", "chunk_").sortWithinPartitions("video_id", "chunk_", first, *order)


def _met_again(texts: DataFrame, local: DataFrame) -> DataFrame:
    """video_id, kind, item, seen: counts, chunk by chunk, of all items that any chunk of their video has found."""
    found = local.select("video_id", F.explode("items").alias("x")).select("video_id", "x.kind", "x.item").distinct()
    sought = found.groupBy("video_id").agg(F.collect_list(F.struct("kind", "item", F.lit(0).cast("long").alias("seen"))).alias("sought"))
    named = local.select("video_id", "chunk_").join(sought, "video_id")
    schema = "video_id string, kind string, item string, seen long"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished() -> Iterator[pa.RecordBatch]:
            if held:
                counts = _count_again(items, held)
                yield pa.RecordBatch.from_pylist([{"video_id": now[0], "kind": k, "item": i, "seen": n} for (k, i), n in counts.items()], kinds)

        now, items, held = None, [], []
        for batch in batches:
            for video, part, text, told in zip(*(batch.column(c).to_pylist() for c in ("video_id", "chunk_", "text", "sought"))):
                if (video, part) != now:
                    yield from finished()
                    now, items, held = (video, part), told or [], []
                if told is None and items:
                    held.append(text)
        yield from finished()

    return _told(texts.join(named.select("video_id").distinct(), "video_id", "left_semi"), named, "sought").mapInArrow(count, schema)


class Runs(dict):
    """What a run becomes, looked up once for each different run of a video."""

    def __init__(self, chrome: frozenset[str]):
        self.chrome = chrome

    def __missing__(self, run: str) -> str:
        self[run] = made = "" if run.isascii() and run.lower() in self.chrome else " " if run in self.chrome else run
        return made


class Cleaner:
    """Slide text without page numbers and one video's decoration.

    Runs that are decoration go first, then longer decoration inside of runs, longest first and of equally long ones in
    code point order, then single characters standing alone, then signs. If that leaves less than three tenths of
    8 or more Han characters, the text was taken for decoration: only page numbers go then.
    """

    def __init__(self, chrome: list[str]):
        self.chrome = frozenset(chrome)
        inner = sorted((g for g in self.chrome if len(g) > 1 and not g.isascii()), key=lambda g: (-len(g), g))
        # looked for one after the other where they are few, or where one with a space might stand across two that have gone
        self.few = inner if len(inner) <= FEW or any(SPACES.search(g) for g in inner) else []
        self.inner = [] if self.few else inner
        self.sizes = np.array([len(g) for g in self.inner], np.int64)
        self.find = automaton(self.inner).iter if self.inner else None
        self.runs = Runs(self.chrome)
        self.alone = any(HAN_SIGN.fullmatch(g) for g in self.chrome)

    def _without_runs(self, text: str) -> str:
        parts = WHOLE_RUN.split(text)
        parts[1::2] = map(self.runs.__getitem__, parts[1::2])
        return "".join(parts)

    def _without_inner(self, text: str) -> str:
        """Items are taken by rank and then place; a place that is taken already is free for no later one."""
        for g in self.few:
            text = text.replace(g, " ")
        matches = list(self.find(text)) if self.find else []
        if not matches:
            return text
        end, rank = np.array(matches).T
        size = self.sizes[rank]
        taken = np.zeros(len(text), bool)
        for n in np.unique(size)[::-1].tolist():
            # what has been taken is as long as this at least, so that it holds an end of this if it meets it
            free = np.flatnonzero((size == n) & ~taken[end] & ~taken[end - size + 1])
            for e in end[free[np.argsort(rank[free], kind="stable")]].tolist():
                if not taken[e] and not taken[e - n + 1]:
                    taken[e - n + 1 : e + 1] = True
        signs = list(text)
        for i in np.flatnonzero(taken).tolist():
            signs[i] = " "
        return "".join(signs)

    def __call__(self, raw: str) -> str:
        paged = PAGE.sub(" ", raw) if "/" in raw else raw
        text = self._without_inner(self._without_runs(paged))
        if self.alone:
            text = ALONE.sub(lambda m: " " if m.group() in self.chrome else m.group(), text)
        done = SPACES.sub(" ", SIGNS.sub(" ", text)).strip(" ")
        if (before := sum(map(len, HAN_RUN.findall(raw)))) >= 8 and sum(map(len, HAN_RUN.findall(done))) < before * 0.3:
            return paged.strip(SPACE_SIGNS)
        return done


#: The characters of SPACE one by one.
SPACE_SIGNS = "".join(c for c in map(chr, range(0x3001)) if SPACES.fullmatch(c))


def _frames_told(frames: DataFrame, chunk: int, *order: str, **ratios: Any) -> DataFrame:
    """frames, each as frame_, after a row with chrome_ for each video and chunk, dealt by them."""
    chunks, chrome = _decoration(frames, chunk, **ratios)
    named = chunks.join(chrome, "video_id").withColumnRenamed("chrome", "chrome_")
    # rows travel as structs, so that their columns may have any name
    rows = frames.select("video_id", F.floor(F.col("index") / chunk).alias("chunk_"), F.struct(*frames.columns).alias("frame_"))
    return _told(rows, named, "chrome_", *order)


def clean_frames(frames: DataFrame, chunk: int = 256, **ratios: Any) -> DataFrame:
    """frames with clean, their text without the video's decoration."""
    schema = StructType([*frames.schema.fields, StructField("clean", StringType())])
    kinds = to_arrow_schema(schema)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cleaner, usual = None, Cleaner(fixed.CHROME_WORDS)
        for batch in batches:
            told, rows = batch.column("chrome_").to_pylist(), batch.column("frame_")
            out = []
            for text, chrome in zip(rows.field("text").to_pylist(), told):
                if chrome is None:
                    out.append(cleaner(text or ""))
                else:
                    cleaner = usual if len(chrome) == len(fixed.CHROME_WORDS) else Cleaner(chrome)
            kept = rows.filter(pa.array([x is None for x in told], pa.bool_())).flatten()
            yield pa.RecordBatch.from_arrays([*(c.cast(k) for c, k in zip(kept, kinds.types)), pa.array(out, pa.string())], schema=kinds)

    return _frames_told(frames, chunk, **ratios).mapInArrow(clean, schema)


def fold_clean_frames(frames: DataFrame, start: Callable[[Any], Fold], schema: str, chunk: int = 256, **ratios: Any) -> DataFrame:
    """Result rows of a fold for each (video, chunk) over its frames as clean_frames has them, in order of index, in the pass that cleans them."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cleaner, usual, fold, out = None, Cleaner(fixed.CHROME_WORDS), None, []
        for batch in batches:
            for video, part, chrome, row in zip(*(batch.column(c).to_pylist() for c in ("video_id", "chunk_", "chrome_", "frame_"))):
                if chrome is None:
                    out += fold.step(row | {"clean": cleaner(row["text"] or "")})
                    continue
                if fold:
                    out += fold.end()
                cleaner, fold = usual if len(chrome) == len(fixed.CHROME_WORDS) else Cleaner(chrome), start((video, part))
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        yield pa.RecordBatch.from_pylist(fold.end() if fold else [], kinds)

    return _frames_told(frames, chunk, "frame_.index", **ratios).mapInArrow(run, schema)


def parted(videos: DataFrame, most_frames: int = WHOLE_FRAMES, most_chars: int = WHOLE_CHARS) -> tuple[DataFrame, DataFrame | None]:
    """videos (video_id, n, chars, frames; a row each) of so many frames and characters at most, and the frames of longer ones, None without any.

    n: size of frames, an array of structs in order of index, text among them; chars: about how many characters their texts have.
    """
    long = (F.col("chars") > most_chars) | (F.col("n") > most_frames)
    frames = videos.filter(long)
    return videos.filter(~long), None if frames.isEmpty() else frames.select("video_id", F.inline("frames"))


def fold_clean_videos(videos: DataFrame, start: Callable[[Any], Fold], schema: str, **ratios: Any) -> DataFrame:
    """Result rows of a fold for each video over its frames as clean_frames has them, in the pass that counts and cleans them.

    videos: video_id, n, frames as parted has them. The pass follows the row's own frames, so that none is dealt or sorted.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    counter = ChunkCounter(**ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual, common, held, out, size, now = Cleaner(fixed.CHROME_WORDS), frozenset(fixed.CHROME_WORDS), [], [], 0, None
        for batch in batches:
            for video, n, row in zip(*(batch.column(c).to_pylist() for c in ("video_id", "n", "frame_"))):
                if held and video != now:
                    raise ValueError(f"frames of videos {now} and {video} are mixed")
                now = video
                held.append(row)
                if len(held) < n:
                    continue
                found = counter([x["text"] or "" for x in held])
                chrome = common.union(item.lower() if kind == "word" else item for kind, item, seen in found if seen >= n * counter.ratios[kind])
                cleaner, fold = Cleaner(list(chrome)) if len(chrome) > len(common) else usual, start(video)
                for x in held:
                    out += fold.step(x | {"clean": cleaner(x["text"] or "")})
                    size += len(x["text"] or "")
                out += fold.end()
                held = []
                if size > FLUSH_CHARS:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, kinds)

    return videos.select("video_id", "n", F.explode("frames").alias("frame_")).mapInArrow(run, schema)
