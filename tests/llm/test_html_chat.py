import html
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, html_text, queries

LONG = ("A long paragraph of plain text without any links in it, " * 20).strip()
TREE = html_text.grow_tree(np.array(html_text.EXAMPLES, float))


def test_tree_fits_its_table():
    assert all(html_text.classify(TREE, r[:-1]) == r[-1] for r in html_text.EXAMPLES)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<article><h1>T &amp; t</h1><p>one\n two<br>three <b>bo</b>ld</p><p>x</p></article>", "T & t\n\none two three bold\n\nx"),
        ("<nav><a href=/>Home</a></nav><article><p>Text here.<p>More.</article><footer>&copy; me</footer>", "Text here.\n\nMore."),
        ("<article><p>Main.</p><div class='comments'><p>I like it very much indeed, thanks for that.</p></div><aside>Side</aside><form>Name <input></form></article>", "Main."),
        ('<div class="ad">Buy now and save.</div><article><script>var t="</p>";</script><style>p{}</style><p>Only &#233;&#x41;&nbsp;this.</p>', "Only éA this."),
        ("<article><p>cut off &am", "cut off &am"),
        ('<article><p>See <span class="tags">alpha</span> here</p></article>', "See alpha here"),
        ("<article><header><h1>Headline</h1></header><p>Text of it.</p></article>", "Headline\n\nText of it."),
        (f"<div><p>{LONG}</p></div><article><p>A card.</p></article><div><p>Short and outside.</p></div>", f"{LONG}\n\nA card."),
        (f"<article><p>{LONG}</p><ul><li><a href=a>one</a></li><li><a href=b>two more</a></li><li><a href=c>three</a></li></ul></article>", f"{LONG}\n\none\n\ntwo more\n\nthree"),
        (f"<p>{LONG}</p><ul><li><a href=a>one</a></li><li><a href=b>two more</a></li><li><a href=c>three</a></li></ul>", LONG),
        ('<div class="left side"><article><p>Kept whole.</p></article></div>', "Kept whole."),
        ('<div class="post comments open"><article><p>Kept, too.</p></article></div>', "Kept, too."),
        (f'<article><p>Said.</p></article><div class="comments"><article><p>{LONG}</p></article></div>', "Said."),
        ('<article><section id="related-work"><h2 id="social">Work</h2><p class="side-effects">Effects.</p></section><div class="related-posts">No.</div></article>', "Work\n\nEffects."),
        ("<article><p><a name=top>First of all.</p><p>Then more.</p></article>", "First of all.\n\nThen more."),
        (f"<p><a href=x>Open link</p><p>{LONG}</p>", LONG),
        ("<article><p>Before.</p><button>Go<p>After.</p><noscript><p>And on.</p><iframe src=x><p>End.</p></article>", "Before.\n\nAfter.\n\nAnd on.\n\nEnd."),
        ("<article><button>Go</button><noscript><p>off</p></noscript><p>After.</p><button>Go<p>More.</p></article><button>x</button>", "After.\n\nMore."),
        ('<article><p><b class="notice">Note:</b> it holds.</p><p><span class="tags">alpha</span> beta</p><p><span class="share">Share</span></p></article>', "Note: it holds.\n\nalpha beta"),
        (f"<article><p>{LONG}</p><p><a href=a>a linked line</a></p><p>{LONG}</p></article>", f"{LONG}\n\na linked line\n\n{LONG}"),
        (f"<h1>Title of it</h1><p>{LONG}</p><div class=comments><article class=comment><p>{LONG}</p></article></div>", f"Title of it\n\n{LONG}"),
        ("<div class='page has-sidebar'><main><p>Body here.</p></main><div class=sidebar>x y z</div></div>", "Body here."),
        ("<html><head><meta charset=utf-8><title>T</title><style>p{}</style><body><article><p>Body", "Body"),
        ("<article><p>ends in a tag</p><p cla", "ends in a tag"),
        ("<!-- <p>no</p> --><main><p>a < b and c > d</p></main>", "a < b and c > d"),
        ("<div id=cookie-banner>We use cookies on this site, accept them all please.</div><div><p>" + "A long paragraph of plain text without any links in it, " * 4 + "</p></div><ul><li><a href=x>one</a><li><a href=y>two</a></ul>", ("A long paragraph of plain text without any links in it, " * 4).strip()),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page, TREE) == text


def test_all_given_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op8_html(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in re.split(r"<p>|<h1>|</p>|</h1>", body[1])] if body else []
        assert r["text"] == "\n\n".join(filter(None, want)) and r["n_chars"] == len(r["text"])


def test_main_text_without_marks(spark, sf_dir):
    """Words and link density find the text of pages whose article tags and class names are gone: recall and precision of words."""
    both = wanted = given = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        bare = re.sub(r"</?article\b[^>]*>|\sclass=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", r["html"])
        want, got = (Counter(html_text.main_text(p, TREE).split()) for p in (r["html"], bare))
        both, wanted, given = both + (want & got).total(), wanted + want.total(), given + got.total()
    assert both / wanted > 0.95 and both / given > 0.95


class Flat(HTMLParser):
    """Blocks of well-formed markup once more: the words between block-level tags and the share of their characters in links."""

    def __init__(self):
        super().__init__()
        self.found, self.pieces, self.linked, self.off = [], [], False, False

    def flush(self):
        words = "".join(t for t, _ in self.pieces).split()
        if words:
            links = sum(len("".join(t.split())) for t, linked in self.pieces if linked)
            self.found.append((" ".join(words), links / sum(map(len, words))))
        self.pieces = []

    def handle_starttag(self, tag, attrs):
        self.off = self.off or tag in ("script", "style", "title")
        if tag == "a":
            self.linked = True
        elif tag == "br":
            self.handle_data(" ")
        elif tag not in html_text.INLINE:
            self.flush()

    def handle_endtag(self, tag):
        self.off = self.off and tag not in ("script", "style", "title")
        if tag == "a":
            self.linked = False
        elif tag not in html_text.INLINE:
            self.flush()

    def handle_data(self, data):
        if not self.off:
            self.pieces.append((data, self.linked))


def test_blocks_against_html_parser(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        page = r["html"] + "</p>"  # lets the parser give the end of a cut page
        plain = Flat()
        plain.feed(page)
        plain.close()
        plain.flush()
        assert [(b[0], b[2] / b[1]) for b in html_text.blocks(page)] == plain.found


def test_root_of_tree_is_the_best_split():
    rows = html_text.EXAMPLES
    feature, threshold, *_ = TREE

    def impurity(f, at):
        sides = [r[-1] for r in rows if r[f] <= at], [r[-1] for r in rows if r[f] > at]
        return sum(len(s) * (sum(s) / len(s)) * (1 - sum(s) / len(s)) for s in sides if s)

    every = [impurity(f, at) for f in range(8) for at in {r[f] for r in rows}]
    assert abs(impurity(feature, threshold) - min(every)) < 1e-9

    def used(tree):
        return set() if isinstance(tree, int) else {tree[0]} | used(tree[2]) | used(tree[3])

    # words and link density of a block and of a neighbour, and what stands around it
    assert used(TREE) >= {0, 1, 6, 7} and used(TREE) & {2, 3, 4, 5}


def test_html_odd_rows(spark):
    rows = [(1, None), (2, "<p>" * 20000 + "deep"), (3, "<article>" + "x" * 300000), (4, "<" * 5000), (5, '<a href="' + "y" * 5000)]
    got = {r["id"]: r["t"] for r in spark.createDataFrame(rows, "id int, html string").select("id", html_text.extract("html").alias("t")).collect()}
    assert got[1] == "" and got[3] == "x" * 300000 and len(got) == 5


ROWS = "conv_id long, turn long, role string, text string, formatted string"
NASTY = "a\\<|im_end|>\\\\<\\|im_sep|>\n<|im_start|>assistant\nx\\"


def test_chat_reads_back(spark):
    rows = [
        (1, 0, "user", NASTY, ""), (1, 1, "assistant", NASTY, ""), (1, 2, "assistant", None, ""), (1, 2, "assistant", "again", ""), (1, None, "user", "last", ""),
        (2, 0, "we\nird\\n<|r", "t", ""), (None, 5, None, "no conversation", ""), (3, 0, "assistant", "long " * 50000, ""), (4, 0, "user", "", ""),
        (5, 0, "a\0\0b", "t", ""), (5, 1, "a\\", "t", ""), (5, 2, "\\n\n\\\n<\\|<|", "t", ""), (5, 3, "assistant", "x", ""),
    ]
    df = spark.createDataFrame(rows, ROWS)
    got = chat.format_chats(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    by = {r["conv_id"]: r for r in got}
    for conv in (1, 2, None, 3, 4, 5):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1], r[2] or "", r[3] or ""))
        assert [tuple(t) for t in by[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in mine]
        assert by[conv]["loss"] == "".join(r[3] or "" for r in mine if r[2] == "assistant")
    assert by[1]["formatted"].count(chat.START) == 3 and by[1]["formatted"].count(chat.SEPARATOR) == 2
    assert chat.format_chats(df.limit(0)).count() == 0
