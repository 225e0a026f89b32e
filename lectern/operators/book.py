"""Assembly of books from paragraphs, chapters and figures, their rendering, and the audit for lost text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.functions.search import automaton
from lectern.operators.chapters import chapter_toc
from lectern.operators.fold import fold_by_key
from lectern.operators.ordered import in_index_range
from lectern.sources.stages import keep


BLOCK = 256
#: Characters of a video's texts that one block holds about, that are searched at once, and an odd number.
BLOCK_CHARS, HELD_CHARS = 1 << 24, 1 << 20
#: Marks that are told to all texts, of eight bytes each.
TOLD_MARKS = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Mentions:
    """Terms of one video, told first, and the first paragraph of a block that holds each."""

    def __init__(self, video_id: Any):
        self.video_id, self.ords, self.keys, self.find, self.met = video_id, {}, [], None, set()

    def step(self, row: dict[str, Any]) -> list[dict[str, Any]]:
        if row["key"] is not None:
            self.ords.setdefault(row["key"], []).append(row["ord"])
            return []
        if self.ords and self.find is None:
            self.keys = list(self.ords)
            self.find = automaton(self.keys).iter
        new = {i for _, i in self.find(row["text"] or "")} - self.met if self.find else ()
        self.met.update(new)
        return [{"video_id": self.video_id[0], "ord": o, "para_idx": row["para_idx"], "t": row["t"]} for i in sorted(new) for o in self.ords[self.keys[i]]]

    def end(self) -> list[dict[str, Any]]:
        return []


def first_mention(glossary: DataFrame, paras: DataFrame, block: int = BLOCK) -> DataFrame:
    """video_id, ord, term, desc, at: where none is given, the time of the first paragraph that holds the term's head.

    Paragraphs are dealt by video and block of indices; each block is told the video's terms and searched for all at once.
    """
    g = glossary.withColumn("key", T.strip(F.regexp_extract("term", "^([^（(/]*)", 1)))
    sought = g.filter("key <> '' AND coalesce(at, '') = ''").select("video_id", "ord", "key")
    texts = paras.select("video_id", F.floor(F.col("para_idx") / block).alias("block"), "para_idx", "t", "text")
    told = texts.select("video_id", "block").distinct().join(sought, "video_id")
    rows = texts.unionByName(told, allowMissingColumns=True)
    met = fold_by_key(rows, ["video_id", "block"], ["para_idx"], Mentions, "video_id string, ord int, para_idx int, t string")
    first = met.groupBy("video_id", "ord").agg(F.min_by("t", "para_idx").alias("first"))
    at = F.coalesce(F.nullif("at", F.lit("")), "first", F.lit(""))
    return g.join(first, ["video_id", "ord"], "left").select("video_id", "ord", "term", "desc", at.alias("at"))


def place_figures(figures: DataFrame, files: DataFrame) -> DataFrame:
    """figures whose image is among files (video_id, file), before or after their paragraph, after by default."""
    return figures.withColumn("pos", F.coalesce("pos", F.lit("after"))).join(files.select("video_id", "file").distinct(), ["video_id", "file"], "left_semi")


def _lines(df: DataFrame, part: int, at: Column, sub: Column, lines: Column) -> DataFrame:
    """video_id, order and line of each of lines, in the book's part, at and sub."""
    rows = df.select("video_id", F.lit(part).alias("part"), at.cast("long").alias("at"), sub.cast("long").alias("sub"), F.posexplode(lines).alias("n", "line"))
    return rows.filter(F.col("line").isNotNull())


def book_rows(meta: DataFrame, chapters: DataFrame, paras: DataFrame, figures: DataFrame, glossary: DataFrame | None, quotes: DataFrame | None) -> DataFrame:
    """video_id, part, at, sub, n, line of each book, in that order: head, about, contents, chapters, glossary, quotes, source; empty parts are left out.

    meta: video_id, title, subtitle, author, lang, rights, about, source_note, time_link, content_frames (null
    if the book has figures). chapters may have part, told before times, and intro. figures: video_id, para_index, pos, k, caption, rel, placed already.
    """
    toc = chapter_toc(chapters, paras)
    parts = [front_rows(meta, toc)]
    start = paras.select("video_id", F.col("para_idx").alias("from_idx"), "start")
    intro = F.col("intro") if "intro" in chapters.columns else F.lit(None).cast("string")
    opened = chapters.select("video_id", "ch", "from_idx", "to_idx", intro.alias("intro")).join(toc, ["video_id", "ch"]).join(start, ["video_id", "from_idx"], "left").join(meta.select("video_id", "time_link"), "video_id", "left")
    parts.append(_lines(opened, 3, F.col("ch"), F.lit(-1), _opening(F.col("stamp"), F.col("start"), F.col("time_link"), F.col("intro"))))
    c = chapters.select("video_id", "ch", "from_idx", "to_idx")
    within = lambda df: in_index_range(c, df, "from_idx", "to_idx")
    parts.append(_lines(within(paras.select("video_id", "para_idx", "text")), 3, F.col("ch"), F.col("para_idx") * 4 + 1, F.array("text", F.lit(""))))
    # figures of one paragraph and side follow in order of k
    shown = within(figures.select("video_id", F.col("para_index").alias("para_idx"), "pos", "k", "caption", "rel"))
    ordered = shown.groupBy("video_id", "ch", "para_idx", "pos").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", _image("caption", "rel").alias("line")))), lambda x: F.array(x["line"], F.lit("")))).alias("lines"))
    parts.append(_lines(ordered, 3, F.col("ch"), _beside(F.col("para_idx"), F.col("pos")), F.col("lines")))
    terms = None if glossary is None else first_mention(glossary, paras)
    none = F.lit(0)
    for part, rows, title, lines in (
        (4, terms, fixed.GLOSSARY_HEAD, F.format_string("| %s | %s | %s |", "term", "desc", "at")),
        (5, quotes, fixed.QUOTES_HEAD, F.format_string("- %s（%s）", "text", "at")),
    ):
        if rows is None:
            continue
        held = rows.select("video_id").distinct()
        parts += [_lines(held, part, F.lit(-1), none, F.array(*map(F.lit, title))), _lines(rows, part, F.col("ord"), none, F.array(lines)), _lines(held, part, F.lit(2**40), none, F.array(F.lit("")))]
    parts.append(_source(meta))
    return reduce(DataFrame.unionByName, parts)


def front_rows(meta: DataFrame, toc: DataFrame) -> DataFrame:
    """The rows of book_rows before the chapters: head, about and contents; toc as chapter_toc has it."""
    none = F.lit(0)
    quoted = lambda k, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f'{k}: "'), F.replace(c, F.lit('"'), F.lit("'")), F.lit('"')))
    head = F.array(F.lit("---"), quoted("title", F.coalesce("title", F.lit(fixed.UNTITLED))), quoted("subtitle", F.col("subtitle")), quoted("author", F.col("author")), quoted("lang", F.coalesce("lang", F.lit(fixed.LANGUAGE))), quoted("rights", F.col("rights")), F.lit("---"), F.lit(""))
    note = F.format_string(fixed.NO_FIGURES, "content_frames")
    about = F.concat(F.array(*map(F.lit, fixed.ABOUT_HEAD)), F.split("about", "\n", -1), F.when(F.col("content_frames").isNotNull(), F.array(F.lit(""), note)).otherwise(F.array().cast("array<string>")), F.array(F.lit("")))
    parts = [_lines(meta, 0, none, none, head), _lines(meta.filter("about <> ''"), 1, none, none, about)]
    parts.append(_lines(meta, 2, F.lit(-1), none, F.array(*map(F.lit, fixed.CONTENTS_HEAD))))
    parts.append(_lines(toc, 2, F.col("ch"), none, F.array(F.format_string("| %d | %s | %s | %d |", "ch", "title", "stamp", "chars"))))
    parts.append(_lines(meta, 2, F.lit(2**40), none, F.array(F.lit(""))))
    return reduce(DataFrame.unionByName, parts)


def _source(meta: DataFrame) -> DataFrame:
    """Rows of the note on sources."""
    source = F.concat(F.array(*map(F.lit, fixed.SOURCE_HEAD)), F.split("source_note", "\n", -1), F.array(F.lit("")))
    return _lines(meta.filter("source_note <> ''"), 6, F.lit(0), F.lit(0), source)


def _opening(stamp: Column, start: Column, time_link: Column, intro: Column) -> Column:
    """A chapter's (ch, title) lines before its first paragraph; null for those that it has not."""
    jump = F.when(time_link.isNotNull(), F.concat(F.lit(fixed.JUMP), T.jump_link(time_link, start), F.lit(")）"))).otherwise("")
    timed = F.when(stamp != "-", F.concat(F.lit(fixed.TIMED[0]), stamp, F.lit(fixed.TIMED[1]), jump))
    led = F.when(intro != "", F.concat(F.lit(fixed.INTRODUCTION), intro))
    return F.array(F.format_string(fixed.CHAPTER_HEAD, "ch", "title"), F.lit(""), timed, F.when(timed.isNotNull(), ""), led, F.when(led.isNotNull(), ""))


def _image(caption: Column | str, rel: Column | str) -> Column:
    return F.concat(F.lit("!["), caption, F.lit("]("), rel, F.lit("){width=6.5in}"))


def _beside(para_idx: Column, pos: Column) -> Column:
    """The place of a paragraph's figures among its chapter's rows, where paragraphs are at 4 * para_idx + 1."""
    return para_idx * 4 + F.when(pos == "before", 0).otherwise(2)


def book_lines(meta: DataFrame, chapters: DataFrame, paras: DataFrame, figures: DataFrame, glossary: DataFrame | None, quotes: DataFrame | None) -> DataFrame:
    """video_id, ord, line: the rows of each book (book_rows), numbered."""
    order = W.partitionBy("video_id").orderBy("part", "at", "sub", "n")
    return book_rows(meta, chapters, paras, figures, glossary, quotes).select("video_id", F.row_number().over(order).alias("ord"), "line")


def assemble_book(lines: DataFrame) -> DataFrame:
    """video_id, book: the lines of each book in one text."""
    return lines.groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "line")))["line"], "\n").alias("book"))


def render_xhtml(books: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """video_id, ch, title, body of each chapter of book texts: figures, quotes and paragraphs, escaped.

    The head and table rows are dropped. files: video_id, file (paths); an image that is not among them is
    marked as missing. None takes all as there.
    """
    plain = F.regexp_replace(F.regexp_replace("book", "(?s)^---\n.*?\n---\n", ""), "(?m)^\\|[^\n]*\\|[^\\S\n]*$", "")
    blocks = F.split(plain, "(?m)^# ", -1)
    docs = books.select("video_id", F.posexplode(F.slice(blocks, 2, F.greatest(F.lit(0), F.size(blocks) - 1))).alias("i", "block"))
    lines = docs.select("video_id", (F.col("i") + 1).alias("ch"), F.posexplode(F.split("block", "\n", -1)).alias("n", "raw"))
    return _documents(lines, ["n"], F.col("n") == 0, files).select("video_id", "ch", "title", "body")


TABLE_ROW = "^\\|[^\n]*\\|[^\\S\n]*\\z"


def render_rows(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """What render_xhtml makes of the book that rows (of book_rows) are, without the book as one text.

    Headings are counted by part and place, so that a chapter's rows are sorted by themselves, and only counts by book.
    """
    place = ["video_id", "part", "at"]
    order = W.partitionBy(*place).orderBy("sub", "n", "m")
    flat = rows.select(*place, "sub", "n", F.posexplode(F.split("line", "\n", -1)).alias("m", "raw"))
    ruled = F.coalesce(F.sum((F.col("raw") == "---").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    headless = flat.filter("part = 0").withColumn("ruled", ruled).filter("ruled >= 2").drop("ruled")
    kept = flat.filter("part > 0").unionByName(headless).withColumn("opens", F.startswith("raw", F.lit("# ")).cast("int"))
    in_book = W.partitionBy("video_id").orderBy("part", "at")
    counts = kept.groupBy(*place).agg(F.sum("opens").alias("heads"))
    before = counts.select(*place, F.coalesce(F.sum("heads").over(in_book.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("heads").over(W.partitionBy("video_id")).alias("last"))
    opened = kept.withColumn("nth", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    numbered = opened.join(before, place).withColumn("ch", (F.col("before") + F.col("nth")).cast("int")).filter("ch > 0")
    title = F.col("opens") == 1
    line = F.when(title, F.substr("raw", F.lit(3))).when(F.col("raw").rlike(TABLE_ROW), "").otherwise(F.col("raw"))
    made = _documents(numbered.withColumn("title_", title).withColumn("raw", line), ["part", "at", "sub", "n", "m"], F.col("title_"), files, F.max("last").alias("last"))
    # what ends before the next heading ends with a line break
    body = F.when((F.col("ch") < F.col("last")) & (F.col("shown") > 0), F.concat("body", F.lit("\n"))).otherwise(F.col("body"))
    return made.select("video_id", "ch", "title", body.alias("body"))


def _documents(lines: DataFrame, order: list[str], title: Column, files: DataFrame | None, *more: Column) -> DataFrame:
    """video_id, ch, title, body, shown (lines in body) of lines (video_id, ch, raw and order), of which each chapter has one title."""
    lines = lines.withColumns({"titled": title, "line": F.regexp_replace("raw", "(?U)\\s+$", "")})
    lines = lines.withColumns({"image": F.col("line").rlike(IMAGE), "alt": F.regexp_extract("line", IMAGE, 1), "src": F.regexp_extract("line", IMAGE, 2)})
    if files is None:
        lines = lines.withColumn("there", F.lit(True))
    else:
        known = files.select("video_id", F.col("file").alias("src"), F.lit(True).alias("there")).distinct()
        lines = lines.join(known, ["video_id", "src"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    shown = _shown(*map(F.col, ("line", "image", "alt", "src", "there")))
    body = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("titled"), F.struct(*order, shown.alias("shown")))))["shown"], "\n")
    return lines.groupBy("video_id", "ch").agg(F.max(F.when(F.col("titled"), T.strip("raw"))).alias("title"), body.alias("body"), F.count_if(~F.col("titled")).alias("shown"), *more)


IMAGE = "^!\\[([^\\]]*)\\]\\(([^)]+)\\)(?:\\{width=[^}]*\\})?\\s*$"


def _shown(line: Column, image: Column, alt: Column, src: Column, there: Column) -> Column:
    """A line that ends without white space as XHTML."""
    wrap = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    figure = F.concat(F.lit('<figure><img src="'), src, F.lit('" alt="'), T.escape_html(alt), F.lit('"/><figcaption>'), T.escape_html(alt), F.lit("</figcaption></figure>"))
    return (
        F.when(line == "", "")
        .when(image & there, figure)
        .when(image, wrap("p", F.concat(F.lit(fixed.MISSING_IMAGE), T.escape_html(alt))))
        .when(F.startswith(line, F.lit("> ")), wrap("blockquote", T.escape_html(F.substr(line, F.lit(3)))))
        .otherwise(wrap("p", T.escape_html(line)))
    )


def chapter_rows(chapters: DataFrame) -> DataFrame:
    """video_id, ch, docs (title, body), what render_rows makes of the chapters of a book whose paragraphs come in the chapter's row.

    chapters: video_id, ch, title, stamp, start, time_link, intro, paras (array of para_idx, text), figures (array of para_idx, pos, k, caption,
    rel), files (array of the images that its lines may show). A chapter is rendered by itself, so that no line is dealt. The line break that ends
    a body before the next chapter is not there, other columns stay.
    """
    at = lambda c: c.cast("long").alias("at")
    texts = F.transform("paras", lambda p: F.struct(at(p["para_idx"] * 4 + 1), F.lit(0).cast("long").alias("k"), F.lit("").alias("line"), F.array(p["text"], F.lit("")).alias("lines")))

    def placed(x: Column) -> Column:
        # figures of one paragraph and side follow in order of k
        image = _image(x["caption"], x["rel"])
        return F.struct(at(_beside(x["para_idx"], x["pos"])), x["k"].cast("long").alias("k"), image.alias("line"), F.array(image, F.lit("")).alias("lines"))

    def shown(raw: Column) -> Column:
        line = F.when(raw.rlike(TABLE_ROW), "").otherwise(F.regexp_replace(raw, "(?U)\\s+$", ""))
        return T.let(line, lambda x: _shown(x, x.rlike(IMAGE), F.regexp_extract(x, IMAGE, 1), F.regexp_extract(x, IMAGE, 2), F.array_contains("files", F.regexp_extract(x, IMAGE, 2))))

    def document(block: Column) -> Column:
        rest = lambda lines: F.slice(lines, F.lit(2), F.size(lines) - 1)
        made = lambda lines: F.struct(T.strip(F.get(lines, F.lit(0))).alias("title"), F.array_join(F.transform(rest(lines), shown), "\n").alias("body"))
        return T.let(F.split(block, "\n", -1), made)

    opening = _opening(F.col("stamp"), F.col("start"), F.col("time_link"), F.col("intro"))
    placed_rows = F.array_sort(F.concat(texts, F.transform("figures", placed)))
    lines = F.concat(opening, F.flatten(F.transform(placed_rows, lambda x: x["lines"])))
    # only a line feed parts lines; what a chapter begins with is a heading
    blocks = F.split(F.array_join(lines, "\n"), "(?dm)^# ", -1)
    docs = T.let(blocks, lambda b: F.transform(F.slice(b, F.lit(2), F.size(b) - 1), document))
    return chapters.withColumn("docs", docs).drop("paras", "figures", "files")


def _spelled(texts: list[str]) -> np.ndarray:
    """The characters of texts as numbers; after each text stands one that is in none."""
    return np.concatenate([np.append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), np.uint32(0xFFFFFFFF)) for t in texts]).astype(np.uint64)


def _marks(signs: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """For each of sizes, rising, and each place a number that tells of so many characters from there on; equal ones may, though hardly ever do, differ."""
    out, length = np.zeros(len(signs) + 1, np.uint64), 0
    for size in sizes:
        while length < size:
            n = max(0, len(signs) - length)
            out = out[:n] * FACTOR + signs[length : length + n]
            length += 1
        yield out


def _found_in_place(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """video_id, prefix: what in texts has one of marks (size, mark), of any video; they are numbers, of which few enough for the driver are given."""
    pairs = marks.select("size", "mark").distinct().toArrow()
    size, mark = pairs.column("size").to_numpy(), pairs.column("mark").to_numpy().view(np.uint64)
    sought = [(int(n), np.sort(mark[size == n])) for n in np.unique(size)]

    # a mark's first bits are looked up in a table of some 32 places a mark
    shifts = [np.uint64(64 - min(24, (32 * len(numbers)).bit_length())) for _, numbers in sought]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = []
        for (_, numbers), shift in zip(sought, shifts):
            tables.append(np.zeros(1 << 64 - int(shift), bool))
            tables[-1][numbers >> shift] = True

        def found() -> pa.RecordBatch:
            out, signs = set(), _spelled(held)
            ends = np.cumsum([len(t) + 1 for t in held])
            for (n, numbers), shift, table, m in zip(sought, shifts, tables, _marks(signs, [n for n, _ in sought])):
                likely = np.flatnonzero(table[m >> shift])
                place = np.minimum(np.searchsorted(numbers, m[likely]), len(numbers) - 1)
                likely = likely[numbers[place] == m[likely]]
                for i, owner in zip(likely.tolist(), np.searchsorted(ends, likely, "right").tolist()):
                    out.add((videos[owner], signs[i : i + n].astype("<u4").tobytes()))
            there = [(v, t.decode("utf-32-le", "surrogatepass")) for v, t in out if b"\xff\xff\xff\xff" not in t]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in there], pa.string()) for i in (0, 1)], ["video_id", "prefix"])

        videos, held, chars = [], [], 0
        for batch in batches if sought else ():
            for video, plain in zip(batch.column("video_id").to_pylist(), batch.column("plain").to_pylist()):
                videos.append(video)
                held.append(plain)
                chars += len(plain)
                if chars > HELD_CHARS:
                    yield found()
                    videos, held, chars = [], [], 0
        if held:
            yield found()

    return texts.select("video_id", "plain").mapInArrow(search, "video_id string, prefix string").distinct()


def _begun_elsewhere(sought: DataFrame, texts: DataFrame) -> DataFrame:
    """video_id, prefix of sought (distinct ones, not empty) that stand somewhere in texts (video_id, plain).

    Up to TOLD_MARKS are told to all texts where they lie. Where there are more, a video's texts are dealt to blocks of about BLOCK_CHARS
    characters, and each block is told the marks of all that is sought in it. What has such a mark is compared as text.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(p), int(next(_marks(_spelled([p]), [len(p)]))[0].view(np.int64))) for p in batch.column("prefix").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64())], ["video_id", "size", "mark"])

    marks = keep(sought.select("video_id", "prefix").mapInArrow(mark, "video_id string, size int, mark long"))
    if marks.count() <= TOLD_MARKS:
        likely = _found_in_place(texts, marks)
        return sought.select("video_id", "prefix").join(likely, ["video_id", "prefix"], "left_semi")
    told = marks.groupBy("video_id", "size").agg(F.collect_set("mark").alias("marks")).groupBy("video_id").agg(F.collect_list(F.struct("size", "marks")).alias("told"))
    sizes = texts.groupBy("video_id").agg(F.ceil(F.sum(F.length("plain")) / BLOCK_CHARS).alias("blocks")).filter("blocks > 0")
    to_blocks = told.join(sizes, "video_id").select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "told")
    # of videos with several blocks there is one for each BLOCK_CHARS characters at most; texts stay where they lie until they are dealt
    dealt = texts.join(F.broadcast(sizes.filter("blocks > 1")), "video_id", "left").select("video_id", F.coalesce(F.pmod(F.xxhash64("plain"), "blocks"), F.lit(0)).alias("block"), "plain")
    rows = dealt.unionByName(to_blocks, allowMissingColumns=True).repartition("video_id", "block").sortWithinPartitions("video_id", "block", F.col("told").isNull())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, marks, held, size = None, [], [], 0

        def found() -> pa.RecordBatch:
            out = set()
            if marks and held:
                signs = _spelled(held)
                for (n, sought), m in zip(marks, _marks(signs, [n for n, _ in marks])):
                    likely = np.flatnonzero(np.isin(m >> np.uint64(44), sought >> np.uint64(44), kind="table") if len(sought) < 1 << 18 else np.ones(len(m), bool))
                    for i in likely[np.isin(m[likely], sought)].tolist():
                        out.add(signs[i : i + n].astype("<u4").tobytes())
            texts = [t.decode("utf-32-le", "surrogatepass") for t in out if b"\xff\xff\xff\xff" not in t]
            return pa.RecordBatch.from_arrays([pa.array([now and now[0]] * len(texts), pa.string()), pa.array(texts, pa.string())], ["video_id", "prefix"])

        for batch in batches:
            for video, block, plain, told in zip(*(batch.column(c).to_pylist() for c in ("video_id", "block", "plain", "told"))):
                if (video, block) != now:
                    yield found()
                    now, marks, held, size = (video, block), [], [], 0
                if told is not None:
                    marks = sorted(((x["size"], np.array(x["marks"], np.int64).view(np.uint64)) for x in told), key=lambda x: x[0])
                elif marks:
                    held.append(plain)
                    size += len(plain)
                    if size > HELD_CHARS:
                        yield found()
                        held, size = [], 0
        yield found()

    likely = rows.mapInArrow(search, "video_id string, prefix string").distinct()
    return sought.select("video_id", "prefix").join(likely, ["video_id", "prefix"], "left_semi")


def coverage_audit(paras: DataFrame, rendered: DataFrame, chapters: DataFrame | None = None, prefix: int = 24, least: float = 98.0) -> DataFrame:
    """video_id, src_chars, paragraphs, covered, coverage, images, ok: paragraphs whose first characters stand in the rendered text.

    rendered: video_id, html, one row a document, a video's rows being parts of its book. Beginnings meet the beginnings of lines;
    those that begin no line are searched for everywhere, unescaped as they are: signs that rendering escapes make a paragraph
    count as lost. images: different image files shown. A book without paragraphs, or without a document, has a row, too.
    """
    sums = paras.groupBy("video_id").agg(F.sum(F.length("text")).alias("src_chars"), F.count("*").alias("paragraphs"))
    begun = paras.groupBy("video_id", beginning("text", prefix).alias("prefix")).agg(F.count("*").alias("n"))
    return coverage(sums, begun, rendered, chapters, prefix, least)


def beginning(text: Column | str, prefix: int = 24) -> Column:
    """What the audit seeks of a paragraph."""
    return F.substring(F.coalesce(text, F.lit("")), 1, prefix)


def coverage(sums: DataFrame, begun: DataFrame, rendered: DataFrame, chapters: DataFrame | None = None, prefix: int = 24, least: float = 98.0) -> DataFrame:
    """coverage_audit of paragraphs that are counted already: sums (video_id, src_chars, paragraphs) and begun (video_id, prefix, n), by beginning."""
    plain = rendered.select("video_id", T.strip_tags(F.coalesce("html", F.lit(""))).alias("plain"))
    lines = plain.select("video_id", F.explode(F.split("plain", "\n", -1)).alias("line")).select("video_id", F.substring("line", 1, prefix).alias("prefix")).distinct()
    # the empty text is held by any
    met = keep(begun.join(lines.withColumn("held", F.lit(True)), ["video_id", "prefix"], "left").withColumn("held", F.coalesce("held", F.col("prefix") == "")))
    elsewhere = _begun_elsewhere(met.filter("NOT held"), plain).withColumn("found", F.lit(True))
    held = met.join(elsewhere, ["video_id", "prefix"], "left").filter("held OR found").groupBy("video_id").agg(F.sum("n").alias("covered"))
    covered = begun.select("video_id").union(rendered.select("video_id")).distinct().join(held, "video_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))
    shown = rendered.select("video_id", F.explode_outer(F.regexp_extract_all("html", F.lit('<img src="([^"]*)"'), F.lit(1))).alias("src"))
    images = shown.groupBy("video_id").agg(F.count_distinct("src").alias("images"))
    joined = covered.join(sums, "video_id", "left").join(images, "video_id", "left").na.fill(0, ["src_chars", "paragraphs", "images"])
    coverage = F.bround(F.col("covered") / F.greatest(F.lit(1), "paragraphs") * 100, 1)
    out = joined.select("video_id", "src_chars", "paragraphs", "covered", coverage.alias("coverage"), "images", (coverage >= least).alias("ok"))
    if chapters is not None:
        counts = chapters.groupBy("video_id").agg(F.count("*").alias("chapters"))
        out = out.join(counts, "video_id", "left").withColumn("chapters", F.coalesce("chapters", F.lit(0)))
    return out
