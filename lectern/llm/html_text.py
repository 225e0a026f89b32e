"""Main text of web pages from flat text blocks, classified by a decision tree.

A page is cut into flat blocks at its block-level tags. A block is described by its number of words and
link density, those of its neighbours, and what stands around it; a decision tree, trained on the small
labelled table EXAMPLES when the operator is set up, tells main text from the rest. In the table, lists of links
are no main text outside of an article, long text with few links is, even there, and what stands around a
block settles the rest: all of an article's, short blocks, and long ones of the page's frame such as comments.

Defined results: null, empty and markup-only pages give an empty text; broken or cut markup is read as far
as it goes; text of any length is kept whole; repeated rows are read each; an empty table gives an empty result; extract
is a column, so that further columns stay as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments, elements that hold no text, tags and declarations. Raw text goes on to its end tag or the page's end; other
#: elements end at their end tag, or, if there is none before the next of their name, with the text up to the next tag.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<held>noscript|template|iframe|svg|math|object|canvas|audio|video|select|button)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:(?:(?!<(?P=held)\b).)*?</(?P=held)\s*>|[^<]*)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words that make up names in class, id and role, that stand for the page's frame.
FRAME_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
FRAME_WORDS = re.compile(
    r"(?i)ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|respond|replies|disqus|cookies?|consent|gdpr|notice|alert|disclaimer|dialog|footer|foot|header|masthead|menu|modal|nav\w*|newsletter|overlay|pag(?:er|ination)|popup|promo\w*|related|recommended|share|sharing|sidebar|side|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar|widget"
)
#: What may stand beside such a word in a name of several parts; with other parts, as in side-effects, it is no frame.
CONTAINER_WORDS = frozenset("area articles bar block body bottom box button buttons col column container content group icons inner item items left links list main page panel posts primary right secondary section site slot stories thread top unit wrap wrapper 1 2 3".split())
#: Elements whose id names what they are about.
TITLED = frozenset("section h1 h2 h3 h4 h5 h6".split())
FOLLOWED = re.compile(r"\s*[^<\s]")
HREF = re.compile(r"(?i)(?:^|\s)href\b")
NAMES = re.compile(r"""(?is)\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: A paragraph's end tag may be left out before these.
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: The labelled table: words and link density of a block, of the one before and of the one after, framed (1: inside the
#: page's frame), place (2: inside the article, 1: the page marks no article, 0: outside of it), main text or not.
#: Blocks (words, link density) whose label holds beside each of BESIDE (the same of the neighbours), for the given
#: values of framed and places.
BESIDE = [(0, 0.0, 0, 0.0), (3, 1.0, 4, 1.0), (70, 0.0, 90, 0.0), (80, 0.1, 2, 1.0), (6, 0.0, 60, 0.0)]
BETWEEN_LINKS = [(0, 0.0, 1, 1.0), (2, 1.0, 3, 1.0), (1, 1.0, 9, 0.0), (6, 0.9, 70, 0.0), (90, 0.0, 2, 1.0), (250, 0.0, 2, 1.0)]
ALIKE = [
    # lists of links, but for those of an article
    ([(1, 1.0), (2, 1.0), (3, 1.0), (5, 1.0), (8, 0.9), (15, 0.8), (40, 0.7)], BETWEEN_LINKS, (0, 1), (0, 1), 0),
    ([(1, 1.0), (3, 1.0), (8, 0.9), (40, 0.7)], BETWEEN_LINKS, (0,), (2,), 1),
    ([(3, 1.0), (15, 0.8)], BETWEEN_LINKS, (1,), (2,), 0),
    # long text with few links; it must be longer where another part of the page is the article
    ([(28, 0.0), (45, 0.1), (90, 0.0), (200, 0.2), (400, 0.1)], BESIDE, (0,), (1, 2), 1),
    ([(200, 0.0), (400, 0.1), (900, 0.0)], BESIDE, (0,), (0,), 1),
    ([(8, 0.0), (28, 0.0), (45, 0.1), (90, 0.0)], BESIDE, (0,), (0,), 0),
    # headings, captions, short paragraphs of an article
    ([(1, 0.0), (4, 0.0), (9, 0.4), (15, 0.0)], BESIDE, (0,), (2,), 1),
    # a linked line of an article between long paragraphs
    ([(5, 1.0), (12, 1.0)], [(70, 0.0, 90, 0.0), (40, 0.1, 60, 0.0), (90, 0.0, 6, 0.0), (30, 0.0, 30, 0.0), (120, 0.0, 15, 0.0)], (0,), (2,), 1),
    # slogans, small print, comments of readers
    ([(9, 0.0), (60, 0.1), (120, 0.0), (400, 0.0)], BESIDE, (1,), (0, 1, 2), 0),
]
#: Short blocks of pages that mark no article: main text between long ones or above one, else not.
SHORT = [
    (6, 0.0, 5, 1.0, 80, 0.0, 0, 1, 1), (8, 0.0, 70, 0.0, 90, 0.0, 0, 1, 1), (5, 0.0, 60, 0.0, 2, 0.0, 0, 1, 1), (11, 0.0, 45, 0.0, 50, 0.0, 0, 1, 1), (2, 0.0, 90, 0.0, 70, 0.0, 0, 1, 1), (9, 0.0, 8, 0.0, 40, 0.0, 0, 1, 1),
    (3, 0.0, 4, 1.0, 5, 1.0, 0, 1, 0), (6, 0.0, 2, 0.0, 3, 0.0, 0, 1, 0), (4, 0.0, 0, 0.0, 2, 1.0, 0, 1, 0), (5, 0.0, 6, 0.0, 8, 0.0, 0, 1, 0), (2, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0), (9, 0.0, 7, 0.0, 0, 0.0, 0, 1, 0), (9, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0), (6, 0.0, 90, 0.0, 0, 0.0, 0, 1, 0),
]
EXAMPLES = [(*b, *n, framed, place, label) for sizes, near, frames, places, label in ALIKE for b in sizes for n in near for framed in frames for place in places] + SHORT


def grow_tree(rows: np.ndarray, depth: int = 12) -> tuple | int:
    """A tree of (feature, threshold, at or below, above) with labels as leaves, by Gini impurity; label last in rows."""
    labels = rows[:, -1]
    if depth == 0 or (labels == labels[0]).all():
        return int(labels.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for threshold in (values[:-1] + values[1:]) / 2:
            below = rows[:, f] <= threshold
            impurity = sum(part.sum() * (p := labels[part].mean()) * (1 - p) for part in (below, ~below))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(threshold), below
    if best is None:
        return int(labels.mean() >= 0.5)
    _, f, threshold, below = best
    return f, threshold, grow_tree(rows[below], depth - 1), grow_tree(rows[~below], depth - 1)


def classify(tree: tuple | int, row: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def blocks(page: str) -> list[tuple[str, int, int, bool, int]]:
    """Text, characters of words, characters of linked words, framed, place of each flat block with text, in page order."""
    out: list[tuple[str, int, int, bool, int]] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, framed, in the article
    at, anchor = 0, -1  # anchor: depth at which a link has begun
    marked = False

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                n = sum(map(len, words))
                links = sum(map(len, html.unescape(" ".join(linked)).split())) if linked else 0
                framed, inside = stack[-1][1:] if stack else (False, False)
                out.append((" ".join(words), n, min(n, links), framed, 2 if inside else 0))
            text.clear()
            linked.clear()

    def close(i: int) -> None:
        nonlocal anchor
        flush()
        del stack[i:]
        if anchor > len(stack):  # a link without end tag ends with the block that it began in
            anchor = -1

    for m in MARKUP.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            if anchor >= 0:
                linked.append(text[-1])
        at = m.end()
        tag = (m[4] or m[7] or "").lower()
        if not tag:
            if m["raw"] or m["held"] and m["held"].lower() not in ("button", "select"):
                flush()
            continue
        end = bool(m[3] or m[6])
        if tag == "a":
            # without href it is a place, not a link
            anchor = len(stack) if not end and HREF.search(m[5] or m[8] or "") else -1
        elif tag == "br":
            text.append(" ")
        elif tag in INLINE:
            # amid a block's text, a word of the frame is only a name
            if not end and tag not in ("img", "wbr") and not "".join(text).strip() and _is_frame(m, tag):
                flush()
                stack.append((tag, True, bool(stack and stack[-1][2])))
            elif end and stack and stack[-1][0] == tag:
                if FOLLOWED.match(page, at):
                    stack.pop()
                else:
                    close(len(stack) - 1)
        elif end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                flush()
        else:
            flush()
            if tag in CLOSES_P and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
                close(len(stack) - 1)
            if tag not in VOID and tag not in ("html", "body"):
                framed, inside = stack[-1][1:] if stack else (False, False)
                # main, or the page's first article, ends the frame around it, such as a wrapper named for its sidebar
                framed = framed and tag != "main" and not (tag == "article" and not marked)
                # an article's header holds its headline
                framed = framed or tag in FRAME_TAGS and not (inside and tag == "header") or _is_frame(m, tag)
                article = tag in ("article", "main") and not framed
                marked |= article
                stack.append((tag, framed, inside or article))
    if at < len(page) and not re.match(r"<[a-zA-Z/!]", page[at:]):
        text.append(page[at:])
    flush()
    return out if marked else [(*b[:4], 1) for b in out]


def _is_frame(m: re.Match, tag: str) -> bool:
    """Whether one of a tag's names is made of words of the page's frame, and of containers' beside them."""
    for kind, *values in NAMES.findall(m[5] or m[8] or ""):
        if kind.lower() == "id" and tag in TITLED:
            continue
        for name in "".join(values).split():
            parts = [p for p in re.split("[-_]+", name.lower()) if p]
            words = [p for p in parts if FRAME_WORDS.fullmatch(p)]
            if words and all(p in words or p in CONTAINER_WORDS for p in parts):
                return True
    return False


def main_text(page: str, tree: tuple | int) -> str:
    found = blocks(page)
    if not found:
        return ""
    sizes = [(0, 0.0), *((len(b[0].split(" ")), b[2] / b[1]) for b in found), (0, 0.0)]
    rows = ((*sizes[i + 1], *sizes[i], *sizes[i + 2], int(b[3]), b[4]) for i, b in enumerate(found))
    return "\n\n".join(b[0] for b, row in zip(found, rows) if classify(tree, row))


def extract(page: str, examples: list[tuple] | None = None) -> Column:
    """Main text of the pages of a column."""
    tree = grow_tree(np.array(examples or EXAMPLES, float))

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return F.pandas_udf(each, "string")(F.coalesce(F.col(page), F.lit("")))
