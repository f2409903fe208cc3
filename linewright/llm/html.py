"""Main text of web pages by tag-path ratios.

Text is gathered by block, and each block has the path of block tags from the
root. For each path of a page its text length and its punctuation, both per
block, are aggregated; both ratios are smoothed over the neighbouring blocks in
page order and fused into one score by their product. Paths that reach half the
page's mean score select their blocks.

Names are priors of a score: an article or main element doubles it, a class, id or
role of an advert, menu, comment and the like all but cancels it, so that such a
path is content only if it holds long, punctuated text and nothing better does. A
name counts as a whole, or as a compound that ends in such a word (user-comments) or
joins it to a word for a container (comment-list); an element with most of the page's
text and a main heading or article in it is the page's frame, whatever it is called.
Text of links counts for nothing, so lists of links are content nowhere.
Elements that by the language's own definition are no main text (nav, footer, aside,
form, script ...) are left out before. The element that holds most of the selected
text is the article: what is selected in it is kept, and so are its other blocks
(headings, short items), if they do not stand apart.

A step of a path is interned as a number, elements know their parents, and weights
are added up the tree once, so time grows in proportion to the page.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_token = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|xmp|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_names = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_punctuation = re.compile(r"[.,;:!?…。，；：！？、]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that never hold main text, and words of a class, an id or a role that speak against it.
APART = frozenset("head nav footer aside form button select menu dialog object canvas audio video".split())
APART_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer header masthead menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo promoted related remark remarks replies respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that make a compound with one of those the name of its container.
HOLDERS = frozenset("area bar block body box button buttons container content form group icons inner item items left link links list menu panel right row section slot thread unit wrap wrapper".split())
_compound = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
#: Share of a path's text in links from which it is a list of links.
LINKS = 0.8
#: A start tag that ends an open element of the second set.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are one block each: the article is sought above them.
SINGLE = HEADINGS | frozenset("p li dt dd td th pre blockquote figcaption".split())
SMOOTH = 1
#: Factors of a path's score by its elements' names, and what a path that stands apart must reach.
ARTICLE, ASIDE, LEAST_ASIDE = 2.0, 0.001, 50.0


def stands_apart(name: str) -> bool:
    """Whether one class, id or role speaks against an element."""
    parts = [x.lower() for x in _compound.split(name) if x]
    if not parts:
        return False
    return parts[-1] in APART_WORDS or "".join(parts) in APART_WORDS or (parts[0] in APART_WORDS and parts[-1] in HOLDERS)


class Page:
    """Blocks of text, the characters of each that are links', and the elements that hold them."""

    def __init__(self, page: str):
        # element 0 is the root: parent, tag, path kind; 2 if it can't hold main text, 1 if its names speak against it
        self.parent, self.tag, self.kind, self.apart, self.inside = [0], [""], [0], [0], [False]
        self.blocks: list[tuple[int, str]] = []
        self.links: list[int] = []
        self._read(page)
        self._settle()

    def _apart(self, tag: str, attributes: str, parent: int) -> int:
        if tag in APART or (tag == "header" and not self.inside[parent]):
            return 2
        if not attributes or tag in ("html", "body", "article", "main"):
            return 0
        names = [n for _, *values in _names.findall(attributes) for n in next((v for v in values if v), "").split()]
        return int(any(stands_apart(n) and not (self.inside[parent] and n.lower() == "header") for n in names))

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.apart.append(2 if self.apart[parent] == 2 else self._apart(tag, attributes, parent))
        self.inside.append(self.inside[parent] or tag in ("article", "main"))
        return len(self.parent) - 1

    def _settle(self) -> None:
        """Clear the page's frame of what its names say, hand on what names say to what is within, and number the paths."""
        n = len(self.parent)
        weight, holds = [0] * n, [tag in ("article", "main", "h1") for tag in self.tag]
        for node, text in self.blocks:
            weight[node] += len(text)
        for node in range(n - 1, 0, -1):
            weight[self.parent[node]] += weight[node]
            holds[self.parent[node]] |= holds[node]
        kinds: dict[tuple[int, str, int], int] = {}
        for node in range(1, n):
            if self.apart[node] == 1 and holds[node] and 2 * weight[node] > weight[0]:
                self.apart[node] = 0
            self.apart[node] = max(self.apart[node], self.apart[self.parent[node]])
            self.kind.append(kinds.setdefault((self.kind[self.parent[node]], self.tag[node], self.apart[node]), len(kinds) + 1))

    def _read(self, page: str) -> None:
        stack, held, parts, at = [0], Counter(), [], 0
        linked, link = [], False  # the parts in links

        def close() -> None:
            text = " ".join(unescape("".join(parts)).split())
            if text and self.apart[stack[-1]] < 2:
                self.blocks.append((stack[-1], text))
                self.links.append(min(len(text), sum(len(" ".join(unescape(x).split())) for x in linked)))
            parts.clear()
            linked.clear()

        def pop() -> None:
            held[self.tag[stack.pop()]] -= 1

        for m in _token.finditer(page):
            if m.start() > at:
                parts.append(page[at : m.start()])
                if link:
                    linked.append(parts[-1])
            at = m.end()
            tag = (m["tag"] or "").lower()
            if tag == "a":
                link = not m["end"]
            if not tag or tag in INLINE:
                continue
            if tag == "br":
                parts.append(" ")
                continue
            close()
            if tag in VOID:
                continue
            if m["end"]:
                if held[tag]:
                    while self.tag[stack[-1]] != tag:
                        pop()
                    pop()
                continue
            if self.tag[stack[-1]] == "p":
                pop()
            ends = CLOSES.get(tag, ())
            while self.tag[stack[-1]] in ends:
                pop()
            stack.append(self._open(tag, m["attributes"], stack[-1]))
            held[tag] += 1
        parts.append(page[at:])
        close()


def link_lists(page: Page) -> set[int]:
    """Path kinds whose text is mostly links'."""
    text, links = Counter(), Counter()
    for (node, words), n in zip(page.blocks, page.links):
        text[page.kind[node]] += len(words)
        links[page.kind[node]] += n
    return {k for k, n in text.items() if links[k] >= LINKS * n}


def scores(page: Page) -> dict[int, float]:
    """Path kind -> fused, smoothed ratio of text outside links, weighted by the priors of its names, and punctuation."""
    kinds = [page.kind[node] for node, _ in page.blocks]
    held: dict[int, list[float]] = defaultdict(lambda: [0.0, 0, 0])
    for kind, links, (node, text) in zip(kinds, page.links, page.blocks):
        sums = held[kind]
        sums[0] += (len(text) - links) * (ASIDE if page.apart[node] else ARTICLE if page.inside[node] else 1.0)
        sums[1] += len(_punctuation.findall(text))
        sums[2] += 1
    ratio = {k: (chars / n, marks / n + 1) for k, (chars, marks, n) in held.items()}
    smooth: dict[int, float] = defaultdict(float)
    for i, (kind, (node, _)) in enumerate(zip(kinds, page.blocks)):
        # a path that stands apart gains nothing from its neighbours
        near = [ratio[kind]] if page.apart[node] else [ratio[k] for k in kinds[max(0, i - SMOOTH) : i + SMOOTH + 1]]
        text, marks = (ratio[kind][j] + sum(r[j] for r in near) / len(near) for j in (0, 1))
        smooth[kind] += text * marks
    return {k: total / held[k][2] for k, total in smooth.items()}


def chosen(score: dict[int, float]) -> set[int]:
    """Path kinds that reach half the mean score."""
    limit = sum(score.values()) / len(score) / 2
    return {k for k, x in score.items() if x >= limit}


def article_of(page: Page, content: list[int]) -> int:
    """The element that holds the content: an article or main with half of it, else down to where it divides."""
    n = len(page.parent)
    weight, most = [0] * n, [0] * n
    for i in content:
        node, text = page.blocks[i]
        weight[node] += len(text)
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        weight[up] += weight[node]
        if page.tag[node] not in SINGLE and (not most[up] or weight[node] >= weight[most[up]]):
            most[up] = node
    named = [k for k in range(1, n) if page.tag[k] in ("article", "main") and 2 * weight[k] >= weight[0]]
    if named:
        return max(named)
    node = 0
    while most[node] and 4 * weight[most[node]] >= 3 * weight[node]:
        node = most[node]
    return node


def main_text(html: str | None) -> str:
    page = Page(html or "")
    if not page.blocks:
        return ""
    score = scores(page)
    links = link_lists(page)
    if page.blocks and len(links) == len(score):
        links = set()  # nothing but links: they are the text
    kinds = chosen(score) - links
    content = [i for i, (node, _) in enumerate(page.blocks) if page.kind[node] in kinds and (not page.apart[node] or score[page.kind[node]] >= LEAST_ASIDE)]
    if not content:
        return ""
    article = article_of(page, content)
    within = [False] * len(page.parent)
    within[article] = True
    for node in range(article + 1, len(within)):
        within[node] = within[page.parent[node]]
    taken, bare = set(content), page.tag[article] in ("", "html", "body")
    kept = []
    for i, (node, text) in enumerate(page.blocks):
        # a page without a narrower element adds only headings of what is selected
        fills = not page.apart[node] and (page.kind[node] not in links or page.tag[node] in HEADINGS) and (not bare or (page.tag[node] in HEADINGS and i + 1 in taken))
        if within[node] and (i in taken or fills):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars. A null html is empty; a page without main text has an empty text.

    Cut-off markup at a page's end is dropped. Repeated rows each give a row, and an
    empty table none. Other columns are not read. Very long and very deep pages are
    read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
