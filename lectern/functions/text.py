"""Expressions on transcript and slide text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import fixed

BLANKS = "(?U)\\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c evaluated once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col(c), "(?U)^\\s+|\\s+$", "")


def normalize_text(c: Column | str) -> Column:
    """Null becomes empty, runs of white space one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), BLANKS, " "))


def is_filler(c: Column | str) -> Column:
    """True for normalised text that is empty or a filler word alone."""
    return (col(c) == "") | col(c).rlike(fixed.FILLER_PATTERN)


def hms(seconds: Column | str) -> Column:
    """HH:MM:SS of truncated seconds; hours go beyond 24."""
    whole = col(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def term_pattern(term: Column | str) -> Column:
    """Pattern of a term: a Latin term may not stand inside a longer Latin word, any other matches as it is."""
    quoted = F.regexp_replace(col(term), "([^A-Za-z0-9\\s\\p{L}])", "\\\\$1")
    bounded = F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9])"))
    return F.when(col(term).rlike("^[A-Za-z0-9 ._\\-]+$"), bounded).otherwise(F.concat(F.lit("(?iu)"), quoted))


def quote_replacement(c: Column | str) -> Column:
    """A replacement in which nothing stands for a group."""
    return F.regexp_replace(col(c), "([\\\\$])", "\\\\$1")


def tokens(c: Column | str) -> Column:
    """Distinct Han characters and Latin words, case kept."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(f"{fixed.HAN}|[A-Za-z][A-Za-z0-9_\\-]*"), F.lit(0)))


def tokens_lower(c: Column | str) -> Column:
    """Distinct Han characters and lower-case Latin words of two characters or more."""
    words = F.transform(F.regexp_extract_all(col(c), F.lit("[A-Za-z][A-Za-z0-9_\\-]+"), F.lit(0)), F.lower)
    return F.array_union(F.regexp_extract_all(col(c), F.lit(fixed.HAN), F.lit(0)), words)


def gram_chars(c: Column | str) -> Column:
    """The characters that n-grams are made of."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^\\x{4e00}-\\x{9fff}A-Za-z0-9]+", "")


def char_ngrams(c: Column | str, n: int = 4) -> Column:
    """Distinct n-grams of the Han characters and ASCII letters and digits, read off in one pass over them."""
    return F.array_distinct(F.regexp_extract_all(gram_chars(c), F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all; two empty sets have nothing in common."""
    return F.size(F.array_intersect(col(a), col(b))) / F.greatest(F.lit(1), F.size(F.array_union(col(a), col(b))))


def jaccard_strict(a: Column | str, b: Column | str) -> Column:
    """Shared over all; two empty sets are equal."""
    return F.when((F.size(col(a)) == 0) & (F.size(col(b)) == 0), 1.0).otherwise(jaccard(a, b))


def clean_slide(c: Column | str, chrome: Column | str) -> Column:
    """Slide text without page numbers and the decoration in chrome (an array).

    Runs that are decoration go first, then longer decoration inside runs, longest first, then single
    characters standing alone, then signs. If that leaves less than three tenths of 8 or more Han
    characters, the text was taken for decoration: only page numbers go then.
    """
    raw, items = F.coalesce(col(c), F.lit("")), col(chrome)
    paged = F.regexp_replace(raw, fixed.PAGE_NUMBER, " ")
    pieces = F.regexp_extract_all(paged, F.lit(f"{fixed.HAN}+|[A-Za-z][A-Za-z0-9_\\-/.]*|(?U:\\d)+|[\\s\\S]"), F.lit(0))

    def run(p: Column) -> Column:
        plain = p.rlike("^[A-Za-z0-9]")
        return F.when(plain & F.array_contains(items, F.lower(p)), "").when(p.rlike(f"^(?:{fixed.HAN}|(?U:\\d)|[A-Za-z])") & F.array_contains(items, p), " ").otherwise(p)

    grams = F.filter(items, lambda g: g.rlike("[^\\x00-\\x7f]") & (F.length(g) >= 2))
    ordered = F.transform(F.array_sort(F.transform(grams, lambda g: F.struct((-F.length(g)).alias("n"), g.alias("g")))), lambda x: x["g"])
    cleared = F.aggregate(ordered, F.array_join(F.transform(pieces, run), ""), lambda t, g: F.replace(t, g, F.lit(" ")))
    words = F.regexp_extract_all(cleared, F.lit("(?U)\\s+|\\S+"), F.lit(0))
    apart = F.array_join(F.transform(words, lambda w: F.when(w.rlike(f"^{fixed.HAN}$") & F.array_contains(items, w), " ").otherwise(w)), "")
    done = F.trim(F.regexp_replace(F.regexp_replace(apart, "[&§@#]+", " "), BLANKS, " "))
    before = F.regexp_count(raw, F.lit(fixed.HAN))
    return let(done, lambda t: F.when((before >= 8) & (F.regexp_count(t, F.lit(fixed.HAN)) < before * 0.3), strip(paged)).otherwise(t))


def tidy_title(c: Column | str, max_len: int = 38) -> Column:
    """Slide text made fit for a title: signs and leading junk go, a late mark starts it, a long one is cut at a space."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), "[&§@#]+(?U:\\s)*[A-Za-z]?(?U:\\d)*", " "), BLANKS, " "))
    for _ in range(3):
        t = F.trim(F.regexp_replace(t, fixed.JUNK_PREFIX, ""))
    return let(let(t, _from_mark), lambda x: _cut_title(x, max_len))


def _from_mark(t: Column) -> Column:
    """From the last mark on, if it begins early; a generation's number apart, ends trimmed."""
    before = F.regexp_extract(t, f"(?is)^(.*)(?:{fixed.TITLE_START})", 1)
    marked = F.when(t.rlike(f"(?i){fixed.TITLE_START}") & (F.length(before) < 40), F.substr(t, F.length(before) + 1)).otherwise(t)
    apart = F.regexp_replace(marked, "(?i)^(GEN(?U:\\s)*(?U:\\d))(?U:\\s)*[/·]?(?U:\\s)*", "$1 ")
    return F.regexp_replace(F.regexp_replace(apart, BLANKS, " "), "^[ \\-_·./]+|[ \\-_·./]+$", "")


def _cut_title(t: Column, max_len: int) -> Column:
    cut = F.substring(t, 1, max_len)
    last_space = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    short = F.when(last_space > max_len * 0.5, F.substr(cut, F.lit(1), last_space)).otherwise(cut)
    return F.when(t == "", fixed.UNTITLED).when(F.length(t) > max_len, F.concat(F.rtrim(short), F.lit("…"))).otherwise(t)


def is_title_mark(c: Column | str) -> Column:
    return col(c).rlike(fixed.TITLE_MARK)


def looks_like_ui_chrome(c: Column | str) -> Column:
    """True for text of a program's frame: little Han, addresses, many brands, office words, or menus without a sentence."""
    t = F.coalesce(col(c), F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p))
    menu = (count(fixed.MENU_WORDS) >= 3) & (count(fixed.FUNCTION_CHARS) / F.greatest(F.lit(1), F.length(t)) < 0.03)
    return ~t.rlike(fixed.FOUR_HAN) | t.rlike(fixed.URLISH) | (count(fixed.BRANDS) >= 3) | (count(fixed.UI_WORDS) >= 3) | menu


def bvid(url: Column | str) -> Column:
    """The video number in an address; null without one."""
    return F.nullif(F.regexp_extract(col(url), "(BV[0-9A-Za-z]{10})", 1), F.lit(""))


def work_key(url: Column | str, meta_id: Column | str) -> Column:
    own = F.nullif(F.regexp_replace(F.coalesce(col(meta_id), F.lit("")), "[^A-Za-z0-9_\\-]", ""), F.lit(""))
    return F.coalesce(own, bvid(url), F.lit("work"))


def clean_part_title(c: Column | str) -> Column:
    """A part's name without its number and picture quality."""
    name = F.coalesce(col(c), F.lit(""))
    t = F.regexp_replace(name, "[-_]\\s*[0-9]{3,4}[Pp].*$", "")
    t = F.regexp_replace(t, "(?i)[-_]\\s*(高清|标清|超清|AVC|HEVC|AV1)(?![\\p{L}\\p{N}_]).*$", "")
    t = F.regexp_replace(F.regexp_replace(t, "^\\s*[0-9]+[-.][0-9]*[.、\\s]*", ""), "^\\s*[0-9]+[.、\\s]+", "")
    t = F.regexp_replace(t, "^[ \\-_·.]+|[ \\-_·.]+$", "")
    return F.when(t != "", t).otherwise(strip(F.when(name == "", fixed.UNTITLED).otherwise(name)))


def figure_caption(chapter: Column | str, k: Column | str, title: Column | str, t_str: Column | str) -> Column:
    """Numbered caption: the title, or the time where the title is a program's frame."""
    timed = F.format_string(fixed.TIMED_CAPTION, col(chapter), col(k), col(t_str))
    return F.when(looks_like_ui_chrome(title), timed).otherwise(F.format_string(fixed.CAPTION, col(chapter), col(k), col(title)))


def jump_link(link: Column | str, seconds: Column | str) -> Column:
    sep = F.when(F.contains(col(link), F.lit("?")), "&").otherwise("?")
    return F.concat(col(link), sep, F.lit("t="), col(seconds).cast("long").cast("string"))


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "<[^>]+>", "")


def escape_html(c: Column | str) -> Column:
    t = col(c)
    for sign, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(sign), F.lit(named))
    return t


def signature(vec: Column | str) -> Column:
    """The vector with mean 0 and population deviation 1; a deviation of 0 counts as 1e-6."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)

    def scaled(v: Column) -> Column:
        centred = F.transform(F.array(total(v) / F.size(v)), lambda m: F.transform(v, lambda x: x - m))
        c = F.element_at(centred, 1)
        spread = F.array(F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(v)))
        return F.flatten(F.transform(spread, lambda s: F.transform(c, lambda x: x / F.when(s == 0, 1e-6).otherwise(s))))

    numbers = F.array(F.transform(col(vec), lambda x: x.cast("double")))
    return F.when(F.size(col(vec)) > 0, F.flatten(F.transform(numbers, scaled)))


def sig_sim(a: Column | str, b: Column | str) -> Column:
    """Correlation of two signatures; 0 where one is missing or lengths differ."""
    dot = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(col(a).isNull() | col(b).isNull() | (F.size(col(a)) != F.size(col(b))) | (F.size(col(a)) == 0), 0.0).otherwise(dot / F.size(col(a)))
