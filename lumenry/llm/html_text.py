"""Main text of HTML pages from flat text blocks and a decision tree.

A page is cut into flat blocks: runs of text between block-level tags, with
character references decoded and white space made single spaces.  Each block
has its word count and link density, those of its neighbours, and where it
stands: in an element that is beside the article by its tag or by a name that
leaves no doubt, or by a name that an article's wrapper may bear as well; then
what share of the words that may be the article's stands there, and how much of
them and those in no such element is left without it.
A decision tree, trained by this module on a small labelled table, classifies
the blocks; the main ones are joined in page order.

The labelled table is made from the pages in ``labelled_pages``; there, the main
blocks start with a pilcrow.

Results: a null or empty page has an empty text, as has one without main
blocks.  A page that breaks off inside a tag ends before that tag; an end tag
that nothing waits for is passed over.  Whole pages are read, in time that
grows with their length.  Rows are independent: repeated pages give equal
texts.  An empty table gives an empty one.  Columns of any name pass through.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import set_aside

# HTML's element names by what they mean for the flow of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody"
    " td tfoot th thead title tr ul video audio".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "noscript", "template", "textarea", "svg", "math", "object", "canvas", "title", "iframe", "select")
ASIDE_TAGS = frozenset("nav aside footer form dialog button label menu head".split())
MAIN_TAGS = frozenset(("article", "main"))
#: They hold the whole page, whatever their classes say.
WHOLE_TAGS = frozenset(("html", "body"))
#: Words in class, id or role that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promos promotion banner sidebar menu nav navbar navigation breadcrumb"
    " breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup"
    " login share sharing social related recommended recommendations trending popular widget comment comments commentlist respond reply replies"
    " disqus discussion toolbar pagination pager copyright legal disclaimer search skip contentinfo complementary dialog topbar sitenav".split()
)
#: Of these, the ones that say no more than what a text is about, or how its box looks.
DOUBTFUL_WORDS = frozenset(
    "banner promo promos promotion sponsor sponsored notice notices notification alert popup modal overlay dialog share sharing social related"
    " recommended recommendations trending popular widget menu navigation copyright legal disclaimer search skip complementary masthead toolbar".split()
)
MAIN_WORDS = frozenset("article main content post entry story".split())
#: What a name of several parts may have besides: which box it is, never what state a page is in (no-sidebar, comments-open).
BOX_WORDS = MAIN_WORDS | frozenset(
    "site page global top bottom primary secondary mobile header area block box container wrapper wrap inner outer section list item items row"
    " panel module slot unit holder group links link icons buttons button bar body form title text label posts articles stories entries news"
    " leaderboard".split()
)

_TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|(?:svg|math)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?<=/>)"
    r"|(?P<raw>" + "|".join(RAW_TAGS) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[!?/][^>]*+>|[a-zA-Z/][^>]*+>)",
    re.S | re.I,
)
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_NAMES = re.compile(r"[a-z0-9]+")

FEATURES = ["words", "links", "before_words", "before_links", "after_words", "after_links", "aside", "main", "heading", "sentence", "outside", "share", "left"]
#: How much an element is beside the article.
NOT_ASIDE, DOUBTFUL, ASIDE = 0, 1, 2


@lru_cache(maxsize=1 << 14)
def _meaning(name: str) -> tuple[int, bool]:
    """Of a class, id or role as a whole: how much it marks an aside, and whether it marks the article.
    A part that marks an aside counts only where the rest says no more than which box it is;
    content-sidebar and the like are layouts."""
    parts = set(_NAMES.findall(name))
    marks = parts & ASIDE_WORDS
    if marks:
        layout = "sidebar" in parts and parts & {"content", "main"}
        if layout or not all(p in ASIDE_WORDS or p in BOX_WORDS or p.isdigit() for p in parts):
            return NOT_ASIDE, False
        return DOUBTFUL if marks <= DOUBTFUL_WORDS else ASIDE, False
    return NOT_ASIDE, bool(parts & MAIN_WORDS)


def _place(tag: str, attrs: str, in_main: bool) -> tuple[int, bool]:
    """How much what opens here is beside the article, and whether it is the article."""
    if tag in WHOLE_TAGS:
        return NOT_ASIDE, False
    main = tag in MAIN_TAGS
    aside = ASIDE if tag in ASIDE_TAGS or (tag == "header" and not in_main) else NOT_ASIDE
    if attrs and "=" in attrs or "hidden" in attrs.lower():
        means = [_meaning(n) for m in _MARKS.finditer(attrs) for n in (m[1] or m[2] or m[3] or "").lower().split()]
        aside = ASIDE if _HIDDEN.search(attrs) else max([aside, *(a for a, _ in means)])
        main = aside == NOT_ASIDE and (main or any(m for _, m in means)) or main and aside != ASIDE
    return aside, main


class Block:
    """A run of text and where it stands."""

    __slots__ = ("aside", "heading", "links", "main", "text", "within", "words")

    def __init__(self, text: str, words: int, links: int, aside: int, main: bool, heading: bool, within: int):
        #: within: the outermost doubtful element around the block, by number; 0 for none.
        self.text, self.words, self.links, self.aside, self.main, self.heading, self.within = text, words, links, aside, main, heading, within


def flat_blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple] = []  # tag, and what holds outside: aside, main, within
    waiting: dict[str, int] = {}  # open elements by tag, so that a stray end tag costs nothing
    text: list[str] = []
    linked: list[str] = []
    aside, main, within, doubts = NOT_ASIDE, False, 0, 0
    depth = heading = 0
    end = page.rfind(">") + 1
    tail = page[end:].partition("<")[0]  # a tag that never ends, and what it holds, is dropped

    def flush() -> None:
        words = html.unescape("".join(text)).split()
        if words:
            out.append(Block(" ".join(words), len(words), len(html.unescape(" ".join(linked)).split()), aside, main, heading > 0, within))
        text.clear()
        linked.clear()

    def add(part: str) -> None:
        text.append(part)
        if depth:
            linked.append(part)

    def shut() -> tuple:
        tag, *outside = stack.pop()
        waiting[tag] -= 1
        return tuple(outside)

    at = 0
    for m in _TOKEN.finditer(page, 0, end):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            flush()
        if tag in VOID_TAGS:
            continue
        if tag == "a":
            depth = 0 if m["close"] else 1
            continue
        if tag[0] == "h" and len(tag) == 2 and tag[1].isdigit():
            heading = 0 if m["close"] else 1
            continue
        if m["close"]:
            if waiting.get(tag):
                while stack[-1][0] != tag:
                    outside = shut()
                outside = shut()
                if outside != (aside, main, within):
                    flush()
                    aside, main, within = outside
            continue
        attrs = m["attrs"]
        if attrs.endswith("/") and tag not in BLOCK_TAGS:
            continue
        beside, article = _place(tag, attrs, main)
        if tag in BLOCK_TAGS or beside or article:
            if tag not in BLOCK_TAGS:
                flush()
            if tag in ("p", "li") and stack and stack[-1][0] == tag:  # an end tag left out
                aside, main, within = shut()
            stack.append((tag, aside, main, within))
            waiting[tag] = waiting.get(tag, 0) + 1
            if article:
                main = True
                if tag in MAIN_TAGS:
                    aside, within = NOT_ASIDE, 0
            if beside:
                if beside == DOUBTFUL and aside == NOT_ASIDE:
                    doubts += 1
                    within = doubts
                aside = max(aside, beside)
    if at < end:
        add(page[at:end])
    add(tail)
    flush()
    return out


def block_features(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    words = np.array([b.words for b in blocks], dtype=float)
    plain = words - np.minimum(words, [b.links for b in blocks])
    aside = np.array([b.aside for b in blocks])
    within = np.array([b.within for b in blocks])
    main = np.array([b.main for b in blocks])
    x[:, 0], x[:, 1], x[:, 6], x[:, 7] = words, 1 - plain / words, aside, main
    x[:, 8] = [b.heading for b in blocks]
    x[:, 9] = [b.text[-1] in ".!?…:;。\"”»'" for b in blocks]
    x[:, 10] = (main & (aside == NOT_ASIDE)).any() and ~main
    # unlinked words in the same doubtful element, and those in no aside at all
    own = np.where(within > 0, np.bincount(within, plain)[within], 0.0)
    left = plain[aside == NOT_ASIDE].sum()
    x[:, 11] = own / max(plain[aside != ASIDE].sum(), 1.0)
    x[:, 12] = left / np.maximum(left + own, 1.0)
    if n > 1:
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, 0:2], x[1:, 0:2]
    return x


def _sentences(n: int, seed: int) -> str:
    """Invented prose of n words."""
    rng = np.random.default_rng(seed)
    parts = [w.capitalize() if i % 9 == 0 else w for i, w in enumerate("".join(rng.choice(list("abdeilmnorstu"), rng.integers(2, 9))) for _ in range(n))]
    return " ".join(w + "." if i % 9 == 8 or i == n - 1 else w for i, w in enumerate(parts))


def _links(n: int, seed: int) -> str:
    return "".join(f'<li><a href="/{w}">{w}</a></li>' for w in _sentences(n, seed).replace(".", "").split())


@lru_cache(maxsize=1)
def labelled_pages() -> tuple[str, ...]:
    s, k = _sentences, _links
    return (
        f'<nav><ul>{k(6, 1)}</ul></nav><div class="ad">{s(9, 2)}</div><article><h1>¶{s(6, 3)}</h1><p>¶{s(60, 4)}</p><p>¶{s(3, 5)}</p><p>¶{s(90, 6)}</p></article><footer>{s(12, 7)}</footer>',
        f'<header><a href="/">{s(2, 8)}</a><ul>{k(5, 9)}</ul></header><main><h1>¶{s(5, 10)}</h1><p>¶{s(40, 11)} <a href="x">{s(2, 12)}</a></p><ul><li>¶{s(4, 13)}</li><li>¶{s(7, 14)}</li></ul></main><aside>{s(30, 15)}</aside>',
        f'<div id="cookie-notice">{s(25, 16)}</div><div><ul>{k(8, 17)}</ul></div><div><h1>¶{s(7, 18)}</h1><p>¶{s(50, 19)}</p><p>¶{s(4, 20)}</p><p>¶{s(70, 21)}</p></div><div class="comments"><p>{s(40, 22)}</p><p>{s(22, 23)}</p></div><div><a href="a">{s(2, 24)}</a> <a href="b">{s(3, 25)}</a></div>',
        f'<div class="topbar"><p>{s(5, 26)}</p></div><div class="post"><h2>¶{s(4, 27)}</h2><p>¶{s(20, 28)}</p><blockquote>¶{s(11, 29)}</blockquote><div class="share"><a href="s">{s(2, 30)}</a></div><p>¶{s(33, 31)}</p></div><form><p>{s(14, 32)}</p></form>',
        f'<article><p>¶{s(1, 33)}</p><p>¶<a href="q">{s(5, 34)}</a></p><p>¶{s(15, 35)}</p><section id="comments"><h3>{s(2, 36)}</h3><p>{s(35, 37)}</p></section></article><div class="sidebar"><p>{s(45, 38)}</p></div><p><a href="t">{s(4, 39)}</a></p>',
        f'<table><tr><td>{k(4, 40)}</td></tr></table><p>¶{s(80, 41)}</p><p>¶{s(6, 42)}</p><p>¶{s(55, 43)}</p><p><a href="1">{s(1, 44)}</a> <a href="2">{s(2, 45)}</a> <a href="3">{s(2, 46)}</a></p><p>{s(2, 47).replace(".", "")}</p>',
        f'<ul>{k(10, 48)}</ul><h1>¶{s(8, 49)}</h1><p>¶{s(30, 50)}</p><h2>¶{s(3, 51)}</h2><p>¶{s(25, 52)}</p><div role="complementary"><p>{s(28, 53)}</p></div><ul>{k(7, 54)}</ul>',
        f'<main><section class="related"><p>{s(17, 55)}</p></section><p>¶{s(2, 56)}</p><p>¶{s(64, 57)}</p><pre>¶{s(10, 58)}</pre></main><footer><p>{s(20, 59)}</p><ul>{k(5, 60)}</ul></footer>',
        f'<nav><ul>{k(5, 61)}</ul></nav><div class="ad">{s(6, 62)}</div><article><h1>¶{s(5, 63)}</h1><p>¶{s(30, 64)}</p><p>¶{s(1, 65)}</p><p>¶{s(1, 66)}</p><p>¶{s(45, 67)}',
        f'<nav><ul>{k(4, 68)}</ul></nav><article><h1>¶{s(1, 69)}</h1><p>¶{s(1, 70)}</p><p>¶{s(2, 71)}</p><p>¶{s(1, 72)}</p></article><footer>{s(1, 73)}</footer>',
        f'<div class="menu">{k(3, 74)}</div><main><p>¶{s(26, 75)}</p><p>¶{s(1, 76)}</p></main><div class="newsletter"><p>{s(50, 77)}</p></div><div class="promo">{s(1, 78)}</div>',
        f'<aside><p>{s(1, 79)}</p><p>{s(80, 80)}</p></aside><article><p>¶{s(100, 81)}</p><p>¶<a href="y">{s(3, 82)}</a></p></article><aside><p>{s(12, 83)}</p><p>{s(30, 84)}</p></aside>',
        f'<article><h2>¶{s(2, 85).replace(".", "")}</h2><p>¶{s(12, 86)}</p><ul><li>¶{s(1, 87)}</li><li>¶<a href="z">{s(2, 88)}</a></li></ul><p>¶{s(1, 89)}</p></article>',
        f'<header><p>{s(18, 90)}</p></header><div><p>¶{s(44, 91)}</p><p>¶{s(1, 92)}</p><p>¶{s(24, 93)}</p></div><div><p><a href="n">{s(3, 94)}</a></p><p><a href="m">{s(4, 95)}</a></p></div>',
        f'<div><p>{s(14, 96)}</p></div><article><h1>¶{s(4, 97)}</h1><p>¶{s(52, 98)}</p></article><div><p>{s(33, 99)}</p></div><p>{s(7, 100)}</p>',
        f'<div>{s(3, 101)}</div><main><p>¶{s(16, 102)}</p><p>¶{s(2, 103)}</p></main><div><p>{s(60, 104)}</p><p>{s(8, 105)}</p></div>',
        f'<html class="no-search"><body class="single no-sidebar"><header><ul>{k(5, 106)}</ul></header><div class="wrap"><h1>¶{s(5, 107)}</h1><p>¶{s(48, 108)}</p><p>¶{s(27, 109)}</p></div><div class="comments-area"><p>{s(21, 110)}</p></div></body></html>',
        f'<body class="post-template comments-open"><div class="site-header">{s(4, 111)}</div><div class="layout has-sidebar"><p>¶{s(36, 112)}</p><p>¶{s(3, 113)}</p><p>¶{s(61, 114)}</p></div><div id="sidebar"><p>{s(24, 115)}</p></div><footer>{s(8, 116)}</footer></body>',
        f'<nav>{k(4, 117)}</nav><article><h1>¶{s(4, 118)}</h1><div class="legal-text"><p>¶{s(44, 119)}</p><p>¶{s(2, 120)}</p><p>¶{s(31, 121)}</p></div></article><footer>{s(9, 122)}</footer>',
        f'<div class="menu">{k(6, 123)}</div><div class="menu-box"><h2>¶{s(3, 124)}</h2><p>¶{s(26, 125)}</p><p>¶{s(8, 126)}</p></div><div class="comments"><p>{s(60, 127)}</p></div>',
        f'<div class="widget"><p>¶{s(70, 128)}</p><p>¶{s(1, 129)}</p></div><div class="cookie-notice"><p>{s(18, 130)}</p></div>',
        f'<article><p>¶{s(30, 131)}</p><div class="related"><p>{s(9, 132)}</p></div><p>¶{s(12, 133)}</p></article><div class="social-links">{k(3, 134)}</div>',
        f'<div><p>¶{s(25, 135)}</p></div><div class="notice"><p>{s(40, 136)}</p></div><div class="banner"><p>{s(3, 137)}</p></div>',
        f'<article class="post"><p>¶{s(20, 138)}</p><div class="comments"><p>{s(80, 139)}</p><p>{s(70, 140)}</p></div></article>',
    )


def varied_pages(n: int = 48, seed: int = 5) -> list[str]:
    """More labelled pages: random lengths of paragraphs in the layouts above."""
    rng = np.random.default_rng(seed)
    made = []
    doubtful = ("promo", "related", "notice", "banner", "social-box", "popular", "legal", "search-widget")
    for i in range(n):
        at = int(rng.integers(1 << 20))
        length = lambda: int(rng.choice((1, 2, 4, 9, 18, 40, 80)))  # noqa: B023, E731
        body = "".join(f"<p>¶{_sentences(length(), at + j)}</p>" for j in range(int(rng.integers(2, 8))))
        beside = [
            f"<nav><ul>{_links(length() % 9 + 1, at + 20)}</ul></nav>",
            f'<div class="{rng.choice(("ad", "cookie-banner", "sidebar", "comments"))}"><p>{_sentences(length(), at + 21)}</p></div>',
            f"<footer>{_sentences(length(), at + 22)}</footer>",
            f"<ul>{_links(length() % 9 + 1, at + 23)}</ul>",
            f"<form><p>{_sentences(length(), at + 24)}</p></form>",
        ]
        if i % 3 == 0:  # what may be a wrapper's name is one here
            body = f'<div class="{rng.choice(doubtful)}"><p>¶{_sentences(40, at + 27)}</p>{body}</div>'
        else:
            beside.append(f'<div class="{rng.choice(doubtful)}"><p>{_sentences(length(), at + 28)}</p></div>')
            body = f"<p>¶{_sentences(40, at + 27)}</p>{body}"
        if i % 2:  # with an article, plain text outside it is beside it
            body = f"<article><h1>¶{_sentences(4, at + 25)}</h1>{body}</article>"
            beside.append(f"<div><p>{_sentences(length(), at + 26)}</p></div>")
        if i % 5 == 0:  # many small boxes
            beside += [f'<div class="{rng.choice(doubtful)}"><p>{_sentences(20, at + 30 + j)}</p></div>' for j in range(6)]
        rng.shuffle(beside)
        cut = int(rng.integers(len(beside)))
        made.append("".join(beside[:cut][:5]) + body + "".join(beside[cut:][: int(rng.integers(6))]))
    return made


class Tree:
    """A classification tree grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
        self.nodes: list[tuple[int, float, int, int]] = []  # feature, threshold, low, high; feature -1: a leaf of class `low`
        self._grow(x, y, depth, least)

    def _grow(self, x, y, depth, least) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, int(2 * y.sum() >= len(y)), 0))
        if depth == 0 or y.all() or not y.any():
            return at
        best = (len(y) * self._gini(y) - 1e-9, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= t
                if min(low.sum(), (~low).sum()) < least:
                    continue
                cost = low.sum() * self._gini(y[low]) + (~low).sum() * self._gini(y[~low])
                if cost < best[0]:
                    best = (cost, (f, float(t)))
        if best[1] is None:
            return at
        f, t = best[1]
        low = x[:, f] <= t
        a = self._grow(x[low], y[low], depth - 1, least)
        b = self._grow(x[~low], y[~low], depth - 1, least)
        self.nodes[at] = (f, t, a, b)
        return at

    @staticmethod
    def _gini(y) -> float:
        p = y.mean()
        return 2 * p * (1 - p)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            f, t, a, b = self.nodes[node]
            if f < 0:
                out[rows] = bool(a)
            elif len(rows):
                low = x[rows, f] <= t
                todo += [(a, rows[low]), (b, rows[~low])]
        return out


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    xs, ys = [], []
    for page in (*labelled_pages(), *varied_pages()):
        blocks = flat_blocks(page)
        ys += [b.text.startswith("¶") for b in blocks]
        xs.append(block_features(blocks))
    return Tree(np.concatenate(xs), np.array(ys))


def main_text(page: str | None, tree: Tree) -> str:
    blocks = flat_blocks(page or "")
    if not blocks:
        return ""
    good = tree.predict(block_features(blocks))
    return " ".join(b.text for b, g in zip(blocks, good, strict=True) if g)


def extract(pages: DataFrame, *, source: str = "html", name: str = "main_text") -> DataFrame:
    """pages with a column ``name`` in place of ``source``, and of any of that name.  A narrow stage."""
    tree = trained_tree()
    moved, own, back = set_aside(pages, source, name)
    at = pages.columns.index(source)
    rest = [i for i in range(len(own)) if i != at]
    names = [f"column{i}" for i in rest]

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(p.as_py(), tree) for p in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], texts], names=[*names, "made"])

    plain = "".join(f"{moved.schema[i].name} {moved.schema[i].dataType.simpleString()}, " for i in rest)
    return moved.mapInArrow(run, f"{plain}made string").select(*back, F.col("made").alias(name))
