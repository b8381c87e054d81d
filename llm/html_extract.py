"""Main text of web pages by a minimum cut.

A page becomes its text blocks in order and the tree of elements that they stand in. A small linear
classifier with stated weights gives each block the cost of calling it boilerplate and of calling it content; these
are its capacities to the two terminals. Blocks next to each other, and the nearest blocks below one parent, are
joined by smoothness edges whose capacity falls with their distance in the tree. The maximum flow
separates content from boilerplate at the least total cost.

Names (class, id, role, itemprop) tell of boilerplate when they are a listed word as a whole. Compound names ("site-footer") do so everywhere if the word is one of
FIRM ("comment-list", "ad-slot", "cookie-banner"), else outside articles alone; not if a word like "with" or "has" begins the name or stands before the listed word, nor if the
name ends with a state ("comments-open"). What is named for readers' remarks holds no article: an ``article`` that is, or stands in, a comment isn't one. Names don't count for an
element that holds the page's article, nor for one with most of the text of a page without articles unless it is named for remarks, adverts or notices (PASSING).
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import table

SILENT = frozenset("head title script style noscript template svg iframe object select textarea button canvas audio video map datalist".split())
#: What may stand in a head; anything else ends it, as its end tag may be left out.
HEAD = frozenset("head title base link meta script style noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input "
    "math mi mo mn ms mrow mfrac msup msub msubsup msqrt mroot mtext mstyle mover munder munderover mspace semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dt dd figcaption".split())
#: Elements and words of class, id or role that tell of boilerplate.
FRAME = frozenset("nav footer aside form header menu dialog".split())
WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments disqus reply replies respond form login search pagination pager widget toolbar skip "
    "contentinfo complementary copyright disclaimer byline tags".split()
)
#: Words for what readers wrote; words for what is laid into a page; and words that count in compound names inside articles too.
REMARKS = frozenset("comment comments disqus reply replies respond".split())
PASSING = REMARKS | frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices newsletter subscribe subscription signup related recommended recommendations".split())
FIRM = PASSING - {"related", "recommended"} | frozenset("banner nav navigation menu breadcrumb breadcrumbs sidebar footer pagination".split())
#: Costs: of evidence from an ancestor, an article (and of standing outside the page's), a block's kind, links, length, and sentences; and of smoothness.
ANCESTOR, ARTICLE, OUTSIDE, BODY_TEXT, LINKS, LENGTH, SENTENCE, PRIOR, SMOOTH = 9.0, 4.0, 4.0, 1.0, 3.0, 1.0, 0.5, 0.3, 0.6
#: A compound name that begins so tells of the page around, not of the element.
MODIFIERS = frozenset("with without has have no not is in on hide hidden show open closed after before".split())
#: What "related" or "recommended" in a compound must stand with to name a list of other pages.
LISTINGS = frozenset("post posts article articles story stories news link links item items product products entry entries reading videos".split())
STATES = frozenset("open closed on off enabled disabled allowed".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """A block-level element: number of its parent (-1: none), tag, whole and compound listed words of its names, whether in an article or among readers' remarks."""

    __slots__ = ("parent", "depth", "tag", "names", "compounds", "frame_tag", "article", "in_article", "remark", "text", "holds", "frame")

    def __init__(self, parent: int, depth: int, tag: str, names: set[str], compounds: set[str], frame_tag: bool, article: bool, in_article: bool, remark: bool):
        self.parent, self.depth, self.tag, self.names, self.compounds, self.frame_tag, self.article, self.in_article, self.remark = parent, depth, tag, names, compounds, frame_tag, article, in_article, remark
        self.text, self.holds, self.frame = 0, article, 0.0


def named(attrs: list) -> tuple[set[str], set[str]]:
    """The listed words that an element's names are, and those that its names hold in a compound."""
    whole, compound = set(), set()
    for k, v in attrs:
        if k in ("class", "id", "role", "itemprop") and v:
            for name in v.split():
                parts = [x.lower() for x in _PARTS.findall(name)]
                if name.lower() in WORDS:
                    whole.add(name.lower())
                elif len(parts) > 1 and parts[0] not in MODIFIERS and parts[-1] not in STATES:
                    compound.update(x for before, x in zip(["", *parts], parts, strict=False) if x in WORDS and before not in MODIFIERS)
                    if compound & {"related", "recommended"} and not LISTINGS.isdisjoint(parts):
                        compound.add("recommendations")
    return whole, compound


class Blocks(HTMLParser):
    """``blocks``: [text, letters in links, number of the block-level element]; ``elements`` in page order. Memory is linear in the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int]] = []
        self.elements = [Element(-1, 0, "", set(), set(), False, False, False, False)]
        self.stack: list[tuple[str, int]] = []  # tag, number of the nearest block-level element
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.linked = self.silent = self.in_link = 0

    def close_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((text, self.linked, self.stack[-1][1] if self.stack else 0))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open["head"] and tag not in HEAD:
            self.handle_endtag("head")
        if tag not in INLINE:
            self.close_block()
        if tag in VOID:
            return
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):  # these close one another
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == tag:
                    self.handle_endtag(tag)
                    break
                if self.stack[k][0] not in INLINE and self.stack[k][0] not in ("p", "td", "th", "dt", "dd"):
                    break
        at = self.stack[-1][1] if self.stack else 0
        if tag not in INLINE:
            above = self.elements[at]
            whole, compound = named(attrs) if tag not in ("html", "body", "main") else (set(), set())
            remark = above.remark or not REMARKS.isdisjoint(whole | compound)
            article = (tag in ("article", "main") or ("role", "main") in attrs) and not remark
            if article:
                whole, compound = set(), set()
            header = tag == "header" and above.in_article
            self.elements.append(Element(at, above.depth + 1, tag, whole, compound, tag in FRAME and not header, article, (above.in_article or article) and not remark, remark))
            at = len(self.elements) - 1
        self.stack.append((tag, at))
        self.open[tag] += 1
        self.silent += tag in SILENT
        self.in_link += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.close_block()
        if not self.open[tag]:
            return
        while self.stack:
            open_tag = self.stack.pop()[0]
            self.open[open_tag] -= 1
            self.silent -= open_tag in SILENT
            self.in_link -= open_tag == "a"
            if open_tag == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.open["head"] and self.stack and self.stack[-1][0] == "head" and data.strip():
            self.handle_endtag("head")
        if not self.silent:
            self.text.append(data)
            self.linked += len(data) * bool(self.in_link)


def weigh(elements: list[Element], blocks: list[tuple[str, int, int]]) -> None:
    """Fills in each element's evidence of boilerplate, with that of the elements around it."""
    for text, _, at in blocks:
        elements[at].text += len(text)
    for e in reversed(elements):
        if e.parent >= 0:
            elements[e.parent].text += e.text
            elements[e.parent].holds |= e.holds
    total, articles = elements[0].text, elements[0].holds
    for e in elements[1:]:
        above = elements[e.parent]
        told = e.names | e.compounds
        main = e.holds or (not articles and 2 * e.text > total and PASSING.isdisjoint(told))
        firm, loose = bool(e.names) or not FIRM.isdisjoint(e.compounds), bool(e.compounds) and not e.in_article
        e.frame = above.frame + (0.0 if main else float(firm) + e.frame_tag + 0.5 * (loose and not firm))


def content_margin(block: tuple[str, int, int], element: Element, outside: float = 0.0) -> float:
    """Cost of calling the block boilerplate, less that of calling it content."""
    text, linked, _ = block
    kind = BODY_TEXT if element.tag in PARAGRAPHS else 0.0
    article = element.in_article
    return PRIOR - outside * (not article) - ANCESTOR * min(2.0, element.frame) + ARTICLE * article + kind - LINKS * min(1.0, linked / len(text)) + LENGTH * (min(3.0, len(text) / 80) - 0.5) * (not element.frame) + SENTENCE * bool(re.search(r"[.!?…]", text))


def distance(elements: list[Element], a: int, b: int) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a != b:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        steps += 1
    return steps


def edges(blocks: list[tuple[str, int, int]], elements: list[Element]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours, and between the nearest two blocks below each parent."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = max(0, elements[b[2]].parent)
        for j in {i - 1, last.get(parent, -1)} - {-1}:
            out[j, i] = SMOOTH / (1 + distance(elements, b[2], blocks[j][2]))
        last[parent] = i
    return [(j, i, w) for (j, i), w in out.items()]


def minimum_cut(margins: list[float], smooth: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the content side of the minimum cut (Dinic's maximum flow)."""
    n = len(margins)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, m in enumerate(margins):
        edge(source, i, m, 0.0) if m > 0 else edge(i, sink, -m, 0.0)
    for a, b, w in smooth:
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at, path = [0] * (n + 2), []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def main_text(html: str | None) -> str:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    blocks, elements = parser.blocks, parser.elements
    if not blocks:
        return ""
    weigh(elements, blocks)
    outside = OUTSIDE if any(elements[b[2]].in_article for b in blocks) else 0.0
    content = minimum_cut([content_margin(b, elements[b[2]], outside) for b in blocks], edges(blocks, elements))
    return " ".join(b[0] for b, c in zip(blocks, content, strict=True) if c)


def extract(pages: DataFrame) -> DataFrame:
    """pages with ``text`` (empty if there is none or ``html`` is null). Other columns pass through; one named ``text`` is replaced.

    Rows are read one by one, so repeated rows give repeated texts. Memory is linear in a page, however deep its elements.
    """

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        return html.map(main_text, na_action=None)

    return pages.drop("text").withColumn("text", text_of(F.coalesce(F.col("html").cast("string"), F.lit(""))))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, text, n_chars`` of all ``pages``.

    Null and empty pages have an empty text; pages are read whole, in memory linear in the page. Repeated rows have a row each, null ids and urls are kept. Where both sides of the cut cost the same a block is
    boilerplate. Other columns aren't read; an empty table gives none.
    """
    text = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
