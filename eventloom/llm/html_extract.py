"""Main text of web pages by tag-path ratios (operator 3).

Every text node has a root-to-leaf path of labels, an element's label being its tag with its class
and id words. Per page and path the text length and the punctuation are summed and divided by the
number of nodes on the path. Both ratios are smoothed along the page and averaged by path, and fused
into the path's score: punctuation (and a little, as texts may have none) times the square root of length, so
that a path of long texts doesn't put one of short texts in the shade, times the share of the path's text that
lies outside links; a path on which a label names something that is no article (an advert, a notice, a
sidebar, comments and the like; whole words only) scores nothing. Paths whose score reaches a share of the
scores' standard deviation select the content nodes.

Where the page marks its article (an article element, else main), the main text is the one with a level-1
heading and the most content, its lists, tables and short paragraphs too, as nothing of an article may be
lost; articles beside it, and teasers in it, go. Elsewhere it is the lowest element that holds all content
nodes and the title, and in that each part (a container or list) goes that holds neither content nor the title
and doesn't stand right beside the title: there the scores decide what stays. Inside either, lists of links
without content and what is marked as no article are left out. Readers' comments are also known by their
form, whatever they are called: two or more like entries behind other text, without headings, which each
begin with a short line that is no sentence but has a date, a time or a link.
A name does not count for an element that holds a level-1 heading or every article element: such an
element wraps the article, however it is called.

Elements that are never main text by their tag (menus, page headers and footers, asides, forms, scripts,
styles) hold no nodes. Tags are found by scanning for ``<`` and ``>``, and open elements by tables of
their places, so that a page costs time in proportion to its length, however broken it is: unclosed and
stray tags, quotes and comments are tolerated. Raw text (script, style, noscript, textarea, iframe) is
passed over up to its end tag or, as in browsers, to the end of the page. A head ends at its end tag,
the first tag that it can't hold or the first text; svg, math and select end at a flow tag they can't
hold, and svg, math, object and template that end nowhere are no more than their tag.

One map over the rows, no shuffle; memory is bounded by a page. Character references are decoded, white
space inside a block becomes one space, blocks are trimmed, empty blocks vanish, the rest is joined by
a line feed. A null or empty page, or one without main text, gives an empty text. Rows are independent,
so ties and repeated rows change nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

OPENING = re.compile(r"""<(/?)([a-z][^\s/>]*)((?:[^>"']|"[^"<]*"|'[^'<]*')*+)>""", re.I)
SLOPPY = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = frozenset("script style noscript textarea iframe".split())
SKIPPED = frozenset("nav header footer aside form menu dialog button head svg math select object template".split())
OPAQUE = frozenset("svg math select object template".split())  # skipped inside a line of text: they end no block
UNENDED = OPAQUE - {"select"}  # without an end tag in the rest of the page, only the tag is skipped
HEAD = frozenset("title base basefont bgsound link meta noframes template".split())  # what doesn't end the head
NESTED = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext template".split())  # where svg, math and templates hold flow
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = frozenset("html body div article main section table tbody tr td center".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd tr td th".split())
#: What an element ends among its open kind, and what of its open surroundings it doesn't look behind.
SIBLING = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Words that name no article, and words that may stand beside them in one class or id, as in "cookie-banner".
NOISE = frozenset("ad ads advert adverts advertisement advertisements adslot adsense banner sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr notice notices alert modal popup newsletter subscribe subscription signup login sidebar widget widgets related recommended recommendations share sharing social menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead footer comment comments commentlist replies respond disqus contentinfo complementary discussion discussions opinions reply feedback talkback guestbook disclaimer disclaimers teaser teasers outbrain taboola".split())
BESIDE = frozenset("list box bar area block wrapper wrap container item items form button buttons links link section slot unit text body site page global top bottom left right main thread count title header footer side article post posts story stories primary secondary inner outer content reader readers user users visitor visitors your our more latest popular most also legal".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、¡¿]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may each hold one comment, and what the first line of one may show.
ENTRY = frozenset("div li article section dd tr".split())
STAMP = re.compile(r"\d{1,4}[-./:]\d{1,2}|\b(?:19|20)\d\d\b|\b\d+\s?(?:s|m|h|d|min|hours?|days?|weeks?|months?|years?)\b|#\d+")
BYLINE = 80
#: Parts of a page that are dropped where they hold neither content nor the title.
PART = CONTAINER | {"ul", "ol", "dl", "form", "fieldset"}
#: Counts as punctuation of every path.
UNMARKED = 0.05
SMOOTH = np.array([0.05, 0.25, 0.4, 0.25, 0.05])  # a bell over five nodes


class _Element:
    __slots__ = ("tag", "parent", "skipped", "path", "linked", "opaque", "noise", "named", "kept", "plain", "links", "heads", "articles", "content", "titles", "times", "first", "final", "own_title", "score")

    def __init__(self, tag: str, parent: "_Element | None", skipped: bool, path: int, named: bool = False):
        self.tag, self.parent, self.skipped, self.path, self.named = tag, parent, skipped, path, named
        self.linked = tag == "a" or bool(parent and parent.linked)
        self.opaque = tag in OPAQUE or bool(parent and parent.opaque)
        self.noise = self.kept = False
        self.plain = self.links = self.heads = self.articles = self.content = self.titles = self.times = 0  # of all below
        self.score = 0.0
        self.first, self.final, self.own_title = 1 << 60, -1, False  # blocks of the first and the last text; whether a level-1 heading is a child


def no_article(words: str) -> bool:
    """Whether a class, id or role holds a word that names no article, alone or with words that may stand beside it."""
    for word in words.lower().split():
        parts = [p for p in re.split(r"[-_]+", word) if p]
        if any(p in NOISE for p in parts) and all(p in NOISE or p in BESIDE or p.isdigit() for p in parts):
            return True
    return False


def _labels(attributes: str) -> tuple[str, bool]:
    """The words of class and id, and whether these or the role name no article."""
    words, named = [], False
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "role") and m[2]:
            value = unescape(m[2].strip("\"'"))
            named = named or no_article(value)
            if name != "role":
                words += value.lower().split()
    return " ".join(words), named


class _Open:
    """The open elements; where each kind of them is open, for looking up without a search."""

    def __init__(self, root: _Element):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.containers: list[int] = []
        self.flow: list[int] = []

    @property
    def top(self) -> _Element:
        return self.stack[-1]

    def push(self, element: _Element) -> None:
        at = len(self.stack)
        self.stack.append(element)
        self.places.setdefault(element.tag, []).append(at)
        if element.tag in CONTAINER:
            self.containers.append(at)
        if element.tag not in INLINE:
            self.flow.append(at)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, 0 for none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def cut(self, at: int) -> None:
        """Ends the elements from place ``at`` on."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in CONTAINER:
                self.containers.pop()
            if tag not in INLINE:
                self.flow.pop()

    def end(self, tag: str) -> _Element | None:
        """Takes an end tag; the element that it ends."""
        at = self.last(tag)
        if not at or (tag in INLINE and self.containers and self.containers[-1] > at):
            return None  # a stray one; an inline one closes no container
        ended = self.stack[at]
        self.cut(at)
        return ended

    def begin(self, tag: str) -> None:
        """Ends what a start tag ends: an open paragraph, an item or cell before it."""
        if tag in CLOSES_P and self.flow and self.stack[self.flow[-1]].tag == "p":
            self.cut(self.flow[-1])
        if tag in SIBLING:
            own, around = SIBLING[tag]
            at = self.last(*own)
            if at and at > self.last(*around, *OPAQUE):
                self.cut(at)

    def end_skipped(self, tag: str) -> None:
        """Ends an open svg, math or select, which can't hold the flow tag ``tag``; an open object at a new main element."""
        kinds = ["svg", "math", *(["select"] if tag != "hr" else []), *(["object"] if tag in ("body", "article", "main") else [])]
        at = self.last(*kinds)
        if at and at > self.last(*NESTED) and all(e.skipped for e in self.stack[at : at + 1]):
            self.cut(at)


def _tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, name, "/" of an end tag, attributes) of every tag; comments and raw text have an empty name."""
    at, size, last = 0, len(html), html.rfind(">")
    while (start := html.find("<", at)) >= 0:
        at = start + 1
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", "", ""
        elif start < last:
            if at < size and html[at] in "!?":
                at = html.find(">", at) + 1
                yield start, at, "", "", ""
            elif m := OPENING.match(html, start) or SLOPPY.match(html, start):
                at = m.end() if m.re is OPENING else html.find(">", m.end()) + 1
                name, attributes = m[2].lower(), m[3] if m.re is OPENING else html[m.end() : at - 1]
                if name in RAW and not m[1]:
                    found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                    at = html.find(">", found.end()) + 1 if found and found.start() < last else size
                    yield start, at, "", "", ""
                else:
                    yield start, at, name, m[1], attributes


def _nodes(html: str) -> tuple[list[tuple[int, _Element, str]], list[_Element]]:
    """(block number, element, decoded text) of every text node outside skipped elements; all elements."""
    paths: dict[tuple[int, str], int] = {}
    root = _Element("", None, False, -1)
    open_, every = _Open(root), [root]
    nodes: list[tuple[int, _Element, str]] = []
    block = 0
    ends: dict[str, int] = {}  # where the last end tag of each name starts

    def ended(tag: str, at: int) -> bool:
        if tag not in ends:
            ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", html, re.I)), default=-1)
        return ends[tag] >= at

    def text(raw: str) -> None:
        if open_.top.tag == "head" and not raw.isspace():
            open_.cut(len(open_.stack) - 1)
        top = open_.top
        if raw and not top.skipped:
            if not raw.isspace():
                nodes.append((block, top, unescape(raw)))
            elif nodes and nodes[-1][0] == block:
                nodes.append((block, nodes[-1][1], " "))

    at = 0
    for start, end, tag, closing, attributes in _tags(html):
        if start > at:
            text(html[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            text(" ")
            continue
        if closing:
            of = open_.end(tag) or open_.top
            block += tag not in INLINE and not of.opaque
            continue
        top = open_.top
        if top.tag == "head" or (top.tag == "title" and top.parent.tag == "head"):
            if tag in ("html", "head") or (tag in INLINE and top.tag == "title"):
                continue
            if top.tag == "title":
                open_.cut(len(open_.stack) - 1)
            if tag not in HEAD:
                open_.cut(len(open_.stack) - 1)
        elif top.opaque and (tag in CLOSES_P or tag == "body"):
            open_.end_skipped(tag)
        block += tag not in INLINE and tag not in OPAQUE and not open_.top.opaque
        if tag in VOID or (tag in UNENDED and not ended(tag, at)):
            continue
        open_.begin(tag)
        top = open_.top
        if not attributes.endswith("/") or tag in CONTAINER:
            label, named = _labels(attributes) if attributes else ("", False)
            named = named and tag not in ("html", "body", "main")
            element = _Element(tag, top, top.skipped or tag in SKIPPED, paths.setdefault((top.path, f"{tag} {label}"), len(paths)), named)
            open_.push(element)
            every.append(element)
    text(html[at:])
    return nodes, every


def path_scores(of: np.ndarray, length: np.ndarray, marks: np.ndarray, linked: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The score of every path 0..n-1; ``of`` is each node's path, the others are its text length, punctuation
    marks, whether it lies in a link and whether its path names no article."""
    count = np.bincount(of)

    def smoothed(values: np.ndarray) -> np.ndarray:
        """The ratio of each path, smoothed along the page's nodes, averaged by path again."""
        ratio = (np.bincount(of, values) / count)[of]
        padded = np.pad(ratio, len(SMOOTH) // 2, mode="edge")
        return np.bincount(of, sum(w * padded[i : i + len(ratio)] for i, w in enumerate(SMOOTH))) / count

    outside = np.bincount(of, length * ~linked) / np.maximum(np.bincount(of, length), 1)
    return np.sqrt(smoothed(length)) * (UNMARKED + smoothed(marks)) * outside * (np.bincount(of, noise) == 0)


def content_paths(scores: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Which paths select content: a score of ``share`` standard deviations or more, and above nothing."""
    return (scores > 0) & (scores >= share * scores.std())


def _measured(nodes: list[tuple[int, _Element, str]], every: list[_Element]) -> None:
    """Fills what is below each element, and which elements name no article."""
    for block, e, raw in nodes:
        if e.linked:
            e.links += len(raw)
        else:
            e.plain += len(raw)
        e.first, e.final = min(e.first, block), max(e.final, block)
    articles = 0
    for e in reversed(every[1:]):  # children come after their parents
        if not e.skipped:
            e.heads += e.tag == "h1"
            e.parent.own_title |= e.tag == "h1"
            e.titles += e.tag in HEADINGS
            e.times += e.tag == "time"
            own = e.tag in ("article", "main") and not e.named
            e.articles += own
            articles += own
        up = e.parent
        up.plain, up.links, up.heads, up.articles = up.plain + e.plain, up.links + e.links, up.heads + e.heads, up.articles + e.articles
        up.titles, up.times, up.first, up.final = up.titles + e.titles, up.times + e.times, min(up.first, e.first), max(up.final, e.final)
    for e in every[1:]:
        wraps = e.heads > 0 or (articles and e.articles == articles)
        e.noise = e.parent.noise or (e.named and not wraps)


def _region(content: list[_Element]) -> _Element:
    """The lowest element that holds all of ``content``."""
    region = content[0]
    above = {id(region): 0}
    chain = [region]
    while chain[-1].parent:
        chain.append(chain[-1].parent)
        above[id(chain[-1])] = len(chain) - 1
    at = 0
    for e in content[1:]:
        while id(e) not in above:
            above[id(e)] = -1  # looked at
            e = e.parent
        place = above[id(e)]
        at = max(at, place)
    return chain[at]


def _replies(nodes: list[tuple[int, _Element, str]], every: list[_Element], children: dict[int, list[_Element]]) -> None:
    """Marks what looks like readers' comments, whatever it is called: two or more like entries in a row behind other
    text, without headings, that each begin with a short line that is dated, timed or linked and no sentence."""
    lines: dict[int, list] = {}  # of each block: text, whether it holds a link
    for block, e, raw in nodes:
        line = lines.setdefault(block, ["", False])
        if len(line[0]) <= BYLINE:
            line[0] += raw
        line[1] |= e.linked
    begins = min(lines, default=0)

    def entry(e: _Element) -> bool:
        if e.titles or e.final <= e.first:
            return False
        text, linked = lines[e.first]
        text = text.strip()
        return 0 < len(text) <= BYLINE and text[-1] not in ".!?。！？" and bool(linked or e.times or STAMP.search(text))

    for up in every:
        own = [c for c in children.get(id(up), ()) if c.tag in ENTRY and not c.skipped and not c.noise and c.plain + c.links]
        if len(own) < 2 or up.own_title:
            continue
        kinds: dict[int, list[_Element]] = {}
        for c in own:
            kinds.setdefault(c.path, []).append(c)
        for same in kinds.values():
            if len(same) >= 2 and same[0].first > begins and sum(map(entry, same)) * 10 >= 7 * len(same):
                for c in same:
                    c.noise = True
    for e in every[1:]:
        e.noise = e.noise or e.parent.noise


def _article(every: list[_Element]) -> _Element | None:
    """The page's article, or else main element: that with a level-1 heading and the most of the content, None if there is none."""
    for tag in ("article", "main"):
        found = [e for e in every if e.tag == tag and not e.noise and not e.skipped and (e.content or e.heads)]
        if found:
            return max(found, key=lambda e: (e.heads > 0, e.score, -e.first))
    return None


def main_text(html: str | None) -> str:
    """The main text of one page."""
    nodes, every = _nodes(html or "")
    if not nodes:
        return ""
    _measured(nodes, every)
    children: dict[int, list[_Element]] = {}
    for e in every[1:]:
        children.setdefault(id(e.parent), []).append(e)
    _replies(nodes, every, children)
    of = np.unique([e.path for _, e, _ in nodes], return_inverse=True)[1]
    flags = [np.array(x, bool) for x in ([e.linked for _, e, _ in nodes], [e.noise for _, e, _ in nodes])]
    scores = path_scores(of, np.array([len(raw) for *_, raw in nodes], float), np.array([len(PUNCTUATION.findall(raw)) for *_, raw in nodes], float), *flags)
    good = content_paths(scores)[of] & ~flags[1]
    content = []
    for (_, e, raw), g, score in zip(nodes, good, scores[of], strict=True):
        if g:
            content.append(e)
            e.content += 1
            e.score += float(score) * np.log1p(len(raw))
    titles = [e for e in every if e.tag == "h1" and not e.noise and not e.skipped and e.plain + e.links]
    if not content and not titles:
        return ""
    for e in reversed(every[1:]):
        e.parent.content += e.content
        e.parent.score += e.score
    region = _article(every)
    loose = region is None  # no element says where the article is: parts without content or title don't belong to it
    if loose:
        region = _region(content + titles[:1])
    parts: dict[int, list[str]] = {}
    for e in every:
        up = e.parent
        listed = e.tag in ("ul", "ol", "div", "section", "table") and e.links > 2 * e.plain
        apart = loose and e.tag in PART and not e.heads and not (up and up.own_title)
        other = e.tag == "article" and e is not region and not e.heads and bool(up and up.kept) and (region.tag == "article" or e.titles > 0 and e.links > 0)
        e.kept = e is region or bool(up and up.kept and not other and (e.content or not (e.noise or listed or apart)))
    for block, e, raw in nodes:
        if e.kept:
            parts.setdefault(block, []).append(raw)
    return "\n".join(x for x in (" ".join("".join(b).split()) for b in parts.values()) if x)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    source = pages.select(key, url, html)
    kinds = [source.schema[c].dataType.simpleString() for c in (key, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
