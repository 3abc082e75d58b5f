"""Main text of web pages: parser events, text-to-tag ratio, Gaussian smoothing and threshold clustering.

A page is read once by the standard library's streaming parser. Its visible text falls into blocks at block-level tags;
each block is a line, whose ratio is its characters outside links for each tag in it. Ratios are smoothed over neighbouring
lines, and runs of lines above a share of their standard deviation are the content clusters. What the clusters' characters
lie in is the content region: article elements if they hold most of them, else the innermost section that does; in a
section, the text runs from the first to the last cluster, and on through content lines right around it; short lines beside a
cluster, in the same element, belong to it. An element whose names may or may not mean that it isn't the article, and an aside
of one longer block or a menu within an article, goes only if something else speaks against it too: mostly links, form controls, repeated children of
one kind, or a place before the first or after the last cluster. Elements hold a number, their parent's and a weight, which is
summed up the tree once, so that memory and time grow with the page and not with its depth.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the smoothing, in lines; share of the deviation above which a line is content.
SIGMA, THRESHOLD = 1.0, 0.5
#: Children of one kind by which an element is a list of entries.
REPEATED = 2
#: Characters of a single block that make an aside within an article a quotation from it, not a sidebar.
QUOTE = 30
#: Share of the content's characters that article elements must hold to be the region, and that a section must; the least article beside a larger one; share of link text that makes a line a list of links.
EXPLICIT, SECTION, BESIDE, LINKS = 0.5, 0.75, 0.25, 0.6
# Fixed values of HTML: elements by what they do to the text around or in them.
HIDDEN = frozenset(("head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video", "select", "option", "textarea", "button", "datalist"))
ASIDE = frozenset(("nav", "footer", "aside", "form", "dialog", "menu"))
CONTAINERS = frozenset(("body", "main", "article", "section", "div", "header", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "figure", "details", "fieldset", "blockquote", "center"))
SECTIONS = frozenset(("body", "main", "article", "section", "div", "td", "center"))
BREAKS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "caption", "figcaption", "pre", "address", "hr", "summary", "legend", "title"))
CONTROLS = frozenset(("form", "input", "textarea", "select", "button"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Words for what is not the article, words that may also stand for a part of it, and words that say only where or how it stands. A class, id or role marks an element if all its words are among these, one of the first (or second) at least.
NOT_CONTENT = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "topbar", "masthead", "sidebar", "sidebars", "widget", "footer", "share", "sharing", "social",
    "subscribe", "newsletter", "signup", "login", "comment", "comments", "commentlist", "disqus", "respond", "replies", "pagination", "pager", "skip", "toolbar", "complementary", "contentinfo",
))
DOUBTFUL = frozenset(("notice", "notices", "alert", "aside", "related", "recommended", "search", "discussion", "discussions", "thread", "threads", "reviews", "responses"))
NEUTRAL = frozenset((
    "site", "page", "main", "global", "top", "bottom", "left", "right", "header", "head", "container", "wrapper", "wrap", "box", "block", "area", "section", "list", "links", "link", "bar", "buttons", "button", "inner", "outer",
    "primary", "secondary", "item", "items", "panel", "banner", "slot", "unit", "text", "form", "body", "row", "col", "reader", "user", "and", "the", "js", "thread", "threads",
))
ARTICLE_HINTS = frozenset(("articlebody", "article-body", "post-content", "entry-content", "post-body", "main-content", "article-content", "main"))
_WORDS, _SIZES, _MARKED = re.compile(r"[a-z]+"), re.compile(r"[0-9]+x[0-9]+"), re.compile(r"<!\[[^>]*(?:>|$)")


def is_marked(names: str, by: frozenset[str] = NOT_CONTENT) -> bool:
    """Whether one of the names, in lower case, says (or, by DOUBTFUL, may say) that the element isn't the article."""
    for name in names.split():
        words = set(_WORDS.findall(_SIZES.sub("", name)))
        if words and words <= NOT_CONTENT | DOUBTFUL | NEUTRAL and not words.isdisjoint(by):
            return True
    return False


class _Events(HTMLParser):
    """Collects blocks: (text, tags, link characters, number of the element around it)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int]] = []
        self.tag, self.parent = [""], [0]  # of each element; 0 is the page
        self.stack: list[tuple[str, int, bool]] = []  # tag, number, whether its text is skipped
        self.open: Counter[str] = Counter()
        self.explicit: set[int] = set()
        self.doubtful: set[int] = set()
        self.controls: list[int] = []  # the elements around form controls
        self.skipped = self.tags = self.links = self.in_link = 0
        self.parts: list[str] = []

    def end_block(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.blocks.append((text, self.tags, self.links, self.stack[-1][1] if self.stack else 0))
            self.parts.clear()
        self.tags = self.links = self.in_link = 0  # a link that was left open ends with its block

    def push(self, tag: str, skip: bool) -> int:
        self.parent.append(self.stack[-1][1] if self.stack else 0)
        self.tag.append(tag)
        self.stack.append((tag, len(self.tag) - 1, skip))
        self.open[tag] += 1
        self.skipped += skip
        return len(self.tag) - 1

    def pop(self) -> None:
        tag, _, skip = self.stack.pop()
        self.open[tag] -= 1
        self.skipped -= skip

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br" or tag == "wbr":
            self.parts.append(" " if tag == "br" else "")
            self.tags += 1
            return
        named = dict(attrs)
        marks = " ".join(filter(None, (named.get(k) for k in ("class", "id", "role")))).lower()
        in_article = self.open["article"] + self.open["main"] > 0
        marked = bool(marks) and tag not in ("html", "body", "main") and not (tag == "article" and "comment" not in marks) and is_marked(marks)
        within = in_article and tag in ("aside", "menu") and not marked
        doubtful = within or not marked and bool(marks) and tag not in ("html", "body", "main", "article") and is_marked(marks, DOUBTFUL)
        if tag in CONTROLS:
            self.controls.append(self.stack[-1][1] if self.stack else 0)
        block = tag in ASIDE or tag in CONTAINERS
        if block or tag in BREAKS:
            self.end_block()
            while self.stack and self.stack[-1][0] in BREAKS and (self.stack[-1][0] == tag or self.stack[-1][0] not in ("li", "dd", "dt")):  # a marked paragraph ends where the next block begins
                self.pop()
        if tag in ("article", "main", "body"):  # whatever was left open before it isn't around it
            while self.stack and self.stack[-1][2]:
                self.pop()
        if tag in HIDDEN or block or (marked or doubtful or "hidden" in named) and tag not in VOID:
            element = self.push(tag, tag in HIDDEN or (tag in ASIDE and not within) or (tag == "header" and not in_article) or "hidden" in named or marked)
            if tag in ("article", "main") or not ARTICLE_HINTS.isdisjoint(marks.split()) or (named.get("itemprop") or "").lower() == "articlebody":
                self.explicit.add(element)
            if doubtful:
                self.doubtful.add(element)
        elif tag == "a":
            self.in_link = 1
        self.tags += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
        if tag in BREAKS or tag in ASIDE or tag in CONTAINERS:
            self.end_block()
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)
            if self.in_link:
                self.links += len(data)


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Values under a Gaussian of 3 sigma to each side; weights beyond the ends are left out."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def region_of(tag: list[str], parent: list[int], explicit: set[int], at: list[int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Whether each line (in element at[i], with its content characters weight[i]) is in the content region; if that is a section and not article elements, also which lines stand in the elements around it."""
    held = np.zeros(len(tag))
    np.add.at(held, at, weight)
    for x in range(len(tag) - 1, 0, -1):  # elements come after those around them
        held[parent[x]] += held[x]
    best = max((held[x] for x in explicit), default=0.0)
    chosen: set[int] = set()
    if best > 0 and best >= EXPLICIT * held[0]:
        inside = np.zeros(len(tag), bool)
        for x in range(1, len(tag)):
            inside[x] = inside[parent[x]]
            if x in explicit:
                if not inside[x] and held[x] >= BESIDE * best:
                    chosen.add(x)
                inside[x] = inside[x] or x in chosen
        for x in sorted(explicit):  # an inner one instead, if all content of the outer one is in it
            up = parent[x]
            while up and up not in explicit:
                up = parent[up]
            if up in chosen and held[x] >= held[up] > 0:
                chosen.remove(up)
                chosen.add(x)
    else:
        fits = [x for x in range(1, len(tag)) if tag[x] in SECTIONS and held[x] >= SECTION * held[0] > 0]
        chosen = {fits[-1]} if fits else {0}
    inside = np.zeros(len(tag), bool)
    for x in range(len(tag)):
        inside[x] = x in chosen or inside[parent[x]]
    if best > 0 and best >= EXPLICIT * held[0]:
        return inside[at], None
    around, x = {0}, next(iter(chosen))
    while x:
        x = parent[x]
        around.add(x)
    return inside[at], np.array([x in around for x in at])


def main_text(html: str | None) -> str:
    """The article's blocks, joined by empty lines; empty if there is none. Broken markup is read as far as it makes sense."""
    if not html:
        return ""
    events = _Events()
    events.feed(_MARKED.sub("", html))
    if events.rawdata.startswith("<!--"):  # a comment that isn't closed is all comment
        events.rawdata = ""
    events.close()
    events.end_block()
    blocks = events.blocks
    if not blocks:
        return ""
    chars = np.array([len(text) for text, *_ in blocks], float)
    links = np.array([min(n, len(text)) for text, _, n, _ in blocks], float)
    at = np.array([x[3] for x in blocks])
    ratio = smoothed((chars - links) / np.array([max(1, tags) for _, tags, *_ in blocks]))
    linked = links >= LINKS * chars
    linked[1:-1] &= linked[:-2] | linked[2:] | (at[1:-1] != at[:-2]) | (at[1:-1] != at[2:])  # a single one between lines of text is one of them
    content = (ratio >= THRESHOLD * min(ratio.std(), np.median(ratio[ratio > 0], axis=0) if (ratio > 0).any() else 0.0)) & ~linked
    gone = dropped(events, at, chars, links, content)
    weight = np.where(content & ~gone, chars - links, 0.0)
    inside, around = region_of(events.tag, events.parent, events.explicit, at.tolist(), weight)
    if around is None:
        return "\n\n".join(text for (text, *_), ok in zip(blocks, (inside & ~gone).tolist(), strict=True) if ok)
    inside, around = inside & ~gone, around & ~gone
    clusters = np.flatnonzero(content & inside)
    if not len(clusters):
        return ""
    content |= np.isin(at, np.unique(at[clusters])) & ~linked & ~gone  # beside a cluster
    clusters = np.flatnonzero(content & inside)
    first, last = int(clusters[0]), int(clusters[-1])
    while first and content[first - 1] and around[first - 1]:
        first -= 1
    while last + 1 < len(blocks) and content[last + 1] and around[last + 1]:
        last += 1
    return "\n\n".join(blocks[i][0] for i in range(first, last + 1) if (inside[i] or around[i]) and not linked[i])


def dropped(events: _Events, at: np.ndarray, chars: np.ndarray, links: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which lines stand in a doubtful element that something else speaks against too."""
    none = np.zeros(len(at), bool)
    if not events.doubtful:
        return none
    n, parent = len(events.tag), events.parent
    text, linked, controls, first, last, doubted = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, len(at)), np.full(n, -1), np.zeros(n, bool)
    np.add.at(text, at, chars)
    np.add.at(linked, at, links)
    np.add.at(controls, events.controls, 1)
    np.minimum.at(first, at, np.arange(len(at)))
    np.maximum.at(last, at, np.arange(len(at)))
    for x in range(n - 1, 0, -1):  # elements come after those around them
        text[parent[x]], linked[parent[x]], controls[parent[x]] = text[parent[x]] + text[x], linked[parent[x]] + linked[x], controls[parent[x]] + controls[x]
        first[parent[x]], last[parent[x]] = min(first[parent[x]], first[x]), max(last[parent[x]], last[x])
    children: dict[int, Counter[str]] = {x: Counter() for x in events.doubtful}
    held = dict.fromkeys(events.doubtful, 0.0)
    for x in range(1, n):
        doubted[x] = x in events.doubtful or doubted[parent[x]]
        if parent[x] in children and text[x]:
            children[parent[x]][events.tag[x]] += 1
            held[parent[x]] += text[x]
    sure = np.flatnonzero(content & ~doubted[at])
    out = np.zeros(n, bool)
    for x in range(1, n):
        if x in events.doubtful:
            outside = not len(sure) or last[x] < sure[0] or first[x] > sure[-1]
            repeated = max(children[x].values(), default=0) >= REPEATED and held[x] >= SECTION * text[x]
            quote = last[x] == first[x] and text[x] >= QUOTE
            out[x] = outside or controls[x] > 0 or repeated or linked[x] >= 0.5 * text[x] or events.tag[x] == "aside" and not quote
        out[x] = out[x] or out[parent[x]]
    return out[at]


def extracted(pages: DataFrame) -> DataFrame:
    """pages (html; any more columns are kept) with text and n_chars, its code points; html goes. A null or empty page has an empty text.

    Pages are read each by itself, whole, so repeated rows get the same text; columns of pages named text or n_chars are replaced.
    """
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = pages.select(*keep).withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    names, last = schema.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(last)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names)

    return pages.select(*keep, F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
