"""Main text of web pages: flat text blocks, features of the block and its neighbours, a decision tree.

A page is cut into flat blocks of text at block-level tags. A block is described by its number of
words and the share of them inside links, and the same of the blocks before and after it. A small
decision tree, grown from the labelled table of ``html_training``, keeps the blocks of the article.
What encloses a block (article or main elements, elements and class names that announce menus,
headers, adverts, notices or reader comments) is a hint to the tree: a split by a hint counts half
of what it gains, so that words and links decide wherever they can, and hints tell apart blocks that
look alike, such as a headline and an advert of eight words each.

Defined results: null, empty or text-free pages give the empty text; very long pages are read
whole in one pass; unclosed, crossed and cut off tags are recovered from (what a cut off tag
announced is dropped); hidden elements and fallback content count as text inside the article and
are dropped elsewhere; names announce boilerplate as whole class names, or identifiers of
containers, never on headings and on article elements outside comments; repeated rows give equal rows; an empty table gives an empty one; further
columns are neither read nor returned.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame

from streamspec.llm import html_training
from streamspec.llm.common import map_rows, texts_of

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NAME = re.compile(r"[a-z0-9]+")

#: Elements whose content is not text of the page, and elements without content.
RAW = frozenset("script style template iframe svg title textarea canvas".split())
DROPPED = frozenset("head select button datalist audio video".split())
#: Elements whose content is text only inside the article, as that of hidden elements.
FALLBACK = frozenset("noscript object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()) | FALLBACK
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split())
INLINE |= MATH
#: Elements and words in class, id and role that announce something else than the article.
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement alert aside author banner bio breadcrumb breadcrumbs byline captcha comment comments complementary consent contentinfo "
    "cookie cookies copyright dialog disclaimer disqus feedback footer form gdpr header legal links login masthead menu meta modal nav navbar navigation newsletter notice "
    "pager pagination popup privacy promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags teaser toolbar topbar tracking warning widget".split()
)
ARTICLE_NAMES = frozenset("article articlebody content entry main maincontent post prose story".split())
#: What else a name that announces boilerplate may hold, besides numbers: others, such as category-legal, tell a topic.
GENERIC = ARTICLE_NAMES | frozenset("area block body box container content group inner item items list outer page section site top widget wrap wrapper".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies reply respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Whole class names that cut an inline element out of its block: other names on inline elements tell nothing of it.
ADVERT_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promoted promotion".split())
#: Elements of text, whose identifiers are anchors.
ANCHORS = HEADINGS | frozenset("p pre blockquote li dt dd figure figcaption caption".split())
#: A new element of the first kind closes an open one of the second.
CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}

FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "in_article", "outside_article", "in_boiler", "in_header", "heading")
#: Features from this on are hints, and what their splits gain counts so much.
HINTS, HINT_WEIGHT = 6, 0.5


@dataclass
class Block:
    """A flat block: its text, words, words in links, what encloses it, and in the labelled table its label."""

    text: str
    words: int
    linked: int
    article: bool
    boiler: bool
    header: bool
    heading: bool
    label: int


@dataclass(slots=True)
class _Open:
    """An open element with what it and its ancestors announce."""

    tag: str
    article: bool
    boiler: bool
    header: bool
    heading: bool
    link: bool
    hidden: bool
    label: int
    comments: bool = False
    cut: bool = False


def _announced(token: str) -> frozenset[str]:
    """The names of boilerplate that a whole class name or identifier consists of, empty where it tells anything else."""
    parts = _NAME.findall(token)
    joined = "".join(parts)
    if joined in BOILER_NAMES or joined in COMMENT_NAMES:
        return frozenset([joined])
    own = BOILER_NAMES.intersection(parts)
    return own if all(x in BOILER_NAMES or x in GENERIC or x.isdigit() for x in parts) else frozenset()


def _opened(tag: str, attrs: str, up: _Open) -> _Open:
    el = _Open(tag, up.article, up.boiler, up.header, up.heading or tag in HEADINGS, up.link or tag == "a", up.hidden or tag in DROPPED, up.label, up.comments)
    if tag in BOILER_TAGS:
        el.boiler = True
    elif tag == "header":
        el.header = True
    elif tag in ("article", "main"):
        el.article = True
    concealed = tag in FALLBACK
    if attrs and not attrs.isspace():
        tokens: list[str] = []
        ids: list[str] = []
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "role", "itemprop"):
                tokens += value.lower().split()
            elif key == "id":
                ids += value.lower().split()
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                concealed = True
            elif key == "y":
                el.label = int(value)
        if tag in INLINE and tag not in FALLBACK and not ADVERT_NAMES.isdisjoint(tokens):
            el.boiler = True
        if tag not in ("html", "body") and tag not in INLINE and tag not in HEADINGS and (tokens or ids):
            if tag not in ANCHORS:
                # Sections of an article have anchors, too.
                tokens += [x for x in ids if tag != "section" or not up.article or _announced(x) & COMMENT_NAMES]
            # The header of an article is part of it, whether an element or a name tells it.
            told = frozenset().union(*map(_announced, tokens)) - ({"header"} if up.article else set())
            el.comments = el.comments or bool(told & COMMENT_NAMES)
            if told and tag != "main" and (tag != "article" or el.comments):
                el.boiler = True
            elif any(not ARTICLE_NAMES.isdisjoint((*_NAME.findall(x), "".join(_NAME.findall(x)))) for x in tokens):
                el.article = True
    if concealed and not el.article:
        el.hidden = True
    return el


def blocks(html: str) -> list[Block]:
    """The flat blocks of a page in page order, without empty ones."""
    out: list[Block] = []
    root = _Open("", False, False, False, False, False, False, 0)
    stack, parts, at, n = [root], [], 0, len(html)
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            words = unescape("".join(parts)).split()
            parts.clear()
            if words:
                top = stack[-1]
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), top.article, top.boiler, top.header, top.heading, top.label))
        linked = 0

    while at < n:
        m = _TAG.search(html, at)
        end = m.start() if m else n
        if end > at and not stack[-1].hidden:
            piece = html[at:end]
            parts.append(piece)
            if stack[-1].link:
                linked += len(piece.split())
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name or m[5] and at == n and not m[0].endswith(">"):
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if closing:
            if any(e.tag == tag for e in stack):
                if tag not in INLINE or any(e.cut for e in stack[max(i for i, e in enumerate(stack) if e.tag == tag) :]):
                    flush()
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else n
            continue
        if tag == "xmp":  # its content is text as it stands
            flush()
            close = re.compile(r"</xmp(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            if not stack[-1].hidden:
                piece = html[at : close.start() if close else n]
                parts.append(piece.replace("&", "&amp;"))
                linked += len(piece.split()) if stack[-1].link else 0
            flush()
            at = close.end() if close else n
            continue
        if tag in ("br", "hr"):
            parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            flush()
            close = CLOSES.get(tag) or (("p",) if tag != "html" else ())
            for e in reversed(stack):
                if e.tag in close:
                    while stack.pop() is not e:
                        pass
                    break
                if e.tag not in INLINE and e.tag != "p":
                    break
        el = _opened(tag, m[3] or m[6] or "", stack[-1])
        if tag in INLINE and el.boiler != stack[-1].boiler:
            flush()
            el.cut = True
        stack.append(el)
    flush()
    return out


def features(page: list[Block]) -> list[tuple[float, ...]]:
    """A row of FEATURES for each block."""
    has = any(b.article for b in page)
    size = [(float(b.words), b.linked / b.words) for b in page]
    out = []
    for i, b in enumerate(page):
        before = size[i - 1] if i else (0.0, 0.0)
        after = size[i + 1] if i + 1 < len(page) else (0.0, 0.0)
        out.append((*size[i], *before, *after, float(b.article), float(has and not b.article), float(b.boiler), float(b.header), float(b.heading)))
    return out


Node = tuple  # (probability,) or (feature, threshold, below or equal, above)


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = 12, least: int = 6) -> Node:
    """A decision tree by Gini impurity, hints at HINT_WEIGHT, with at least so many rows on each side
    of a test; ties go to the earlier feature, then the lower threshold."""
    ones = sum(y for _, y in rows)
    if depth == 0 or ones in (0, len(rows)):
        return (ones / max(1, len(rows)),)
    whole = ones * (len(rows) - ones) / len(rows)
    best: tuple | None = None
    for f in range(len(rows[0][0])):
        order = sorted((r[f], y) for r, y in rows)
        left = 0
        for i in range(len(order) - 1):
            left += order[i][1]
            a, b = order[i][0], order[i + 1][0]
            nl, nr = i + 1, len(order) - i - 1
            if a < b and nl >= least and nr >= least:
                right = ones - left
                gain = (whole - left * (nl - left) / nl - right * (nr - right) / nr) * (HINT_WEIGHT if f >= HINTS else 1)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, (a + b) / 2)
    if best is None:
        return (ones / len(rows),)
    _, f, t = best
    return (f, t, *(grow([r for r in rows if (r[0][f] <= t) == low], depth - 1, least) for low in (True, False)))


@functools.cache
def tree() -> Node:
    """The tree grown from the labelled table."""
    rows = []
    for html in html_training.pages():
        page = blocks(html)
        rows += zip(features(page), (b.label for b in page), strict=True)
    return grow(rows)


def printed(node: Node, indent: str = "") -> str:
    """A tree as text, a line for each test and leaf."""
    if len(node) == 1:
        return f"{indent}{node[0]:.2f}\n"
    f, t, low, high = node
    return f"{indent}{FEATURES[f]} <= {t:g}\n{printed(low, indent + '  ')}{indent}else\n{printed(high, indent + '  ')}"


def probability(node: Node, row: tuple[float, ...]) -> float:
    while len(node) > 1:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node[0]


def main_text(html: str, node: Node | None = None) -> str:
    """The article's blocks joined by single spaces."""
    node, page = node or tree(), blocks(html)
    return " ".join(b.text for b, row in zip(page, features(page), strict=True) if probability(node, row) >= 0.5)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    node = tree()  # grown once, a few hundred tests

    def make():
        def fn(batch):
            texts = [main_text(h, node) for h in texts_of(batch.column(2))]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": list(map(len, texts))}

        return fn

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_rows(pages.select("page_id", "url", html_col), make, f"page_id {kind}, url string, text string, n_chars long")
