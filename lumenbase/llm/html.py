"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; they become lines (one block of text each) with the number of tags since the
last one. The ratio of text to tags per line is smoothed with a Gaussian, and the lines above a threshold (the standard
deviation of the smoothed ratios) are the cluster of content. The innermost element that holds seven tenths of the cluster's
text is the region of the article, and all of its lines are returned, short and linked ones too.

Markup is evidence beside the ratios:

* what shows no text of its own, or is hidden, is never a line: scripts, styles, controls, drawings;
* an element that is a menu, page header, footer, aside, form or dialog, or has such a role, goes as a whole; of a header inside
  the article only headings stay. A word of class or id on a container, such as `sidebar` or `share`, divides the ratios of
  what is inside by ten, so that it must stand out all the more to be in the cluster; what isn't is left out of the region
  too. Readers' comments, adverts and notices on cookies go however large they are. A word says nothing if it is negated
  (`has-sidebar`, `no-comments`), and of a paragraph only words for adverts and cookies do;
* no element or word is believed of what holds the article: from the outermost inwards, the cluster found without any markup
  tells how much prose stands inside and how much stands free of markup outside. An element is the article's wrapper if eight
  times the prose outside is less than what it holds, or if it holds the page's first heading and no prose is free before
  it, or, for a word of layout, half of all prose that isn't in comments, adverts or notices;
* an <article> or <main> around the region, or an <article> within it that holds most of the cluster, completes the region;
  without one, the element around the region's first heading is the region if no element beside it holds more of the cluster
  (which says nothing if it holds every line of the page), and headings right beside the region complete it.

Defined results: null, empty or textless html gives the empty text; unclosed and crossed elements are closed as far as the
next end tag demands; character references are decoded, unknown ones stay as they are; white space (also a line break
element) inside a block becomes one space; rows with a null id are left out and repeated ids count once, the smallest
(url, html) of them (see common.keyed). Pages of any length are read whole."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbase.llm.common import batch_of, keyed

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: They hold no text of an article; they stand within lines and don't end them.
DROPPED = frozenset("head script style noscript template svg math iframe object canvas audio video button select textarea map".split())
APART = frozenset("nav header footer aside form fieldset dialog menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
LAYOUT_WORDS = frozenset(
    "promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget banner notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations toolbar pagination pager copyright masthead topbar skip".split()
)
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr".split())
READER_WORDS = frozenset("comment comments disqus reply replies respond".split())
NEGATED, FREE = frozenset("has no with without not non".split()), "free"
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = ("article", "main")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
TEXT_BLOCKS = frozenset("p blockquote pre figure figcaption dd dt td th tr tbody thead".split())
SIGMA, REACH = 1.0, 3
PROSE, WRAPS = 140, 8  # how much prose a wrapper holds at least, and how many times what stands free outside


@dataclass
class Element:
    tag: str
    number: int
    dropped: bool
    heading_only: bool
    said: str  # what a word of class or id says ("", "layout" or "strict"), or "apart" for an element that stands apart


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    inside: tuple[int, ...]  # the regions around it, from the outermost
    said: tuple[tuple[int, str], ...]  # the elements around it of which markup says something, from the outermost
    heading: bool


def what_words_say(names: str, block: bool) -> str:
    """Of class names and ids in lower case: 'strict' before 'layout' before ''. A name may negate its words; a block of text
    isn't a region, and only words for adverts and cookies say something of it."""
    found = ""
    for name in names.split():
        words = SPLIT.split(name)
        if NEGATED.isdisjoint(words) and FREE not in words:
            if not ADVERT_WORDS.isdisjoint(words) or not block and not READER_WORDS.isdisjoint(words):
                return "strict"
            if not block and not LAYOUT_WORDS.isdisjoint(words):
                found = "layout"
    return found


@dataclass
class Reader(HTMLParser):
    """Parser events to lines."""

    lines: list[Line] = field(default_factory=list)
    regions: dict[int, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.count = self.tags = self.linked = self.links = 0
        self.said: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.said).split())
        if text:
            inside = tuple(e.number for e in self.open if e.number in self.regions)
            said = tuple((e.number, e.said) for e in self.open if e.said)
            self.lines.append(Line(text, max(1, self.tags), min(self.linked, len(text)), inside, said, any(e.tag in HEADINGS for e in self.open)))
            self.tags = 0
        self.said, self.linked = [], 0

    def said_of(self, tag: str, attrs: dict) -> str:
        if tag in INLINE or tag in HEADINGS or tag in ("html", "body"):
            return ""
        if tag in APART or (attrs.get("role") or "").lower() in APART_ROLES:
            return "apart"
        return what_words_say(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower(), tag in TEXT_BLOCKS)

    @staticmethod
    def hidden(attrs: dict) -> bool:
        return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(HIDDEN.search(attrs.get("style") or ""))

    def ends_line(self, tag: str) -> bool:
        """Whether a tag is a block's; within what is dropped none is."""
        up = self.open[-1] if self.open else None
        return tag not in INLINE and tag not in DROPPED and not (up is not None and up.dropped and not up.heading_only)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.said.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if self.ends_line(tag):
            self.flush()
            if any(e.tag == "p" for e in self.open[-4:]):  # a block ends an open paragraph
                self.close_to("p")
        up = self.open[-1] if self.open else None
        kept_heading = up is not None and up.heading_only and tag in HEADINGS
        named = dict(attrs)
        dropped = (up is not None and up.dropped and not kept_heading) or tag in DROPPED or self.hidden(named)
        inner_header = tag == "header" and not dropped and any(e.tag in REGIONS for e in self.open)
        said = "" if dropped or inner_header else self.said_of(tag, named)
        self.count += 1
        if tag not in INLINE and tag != "p" and tag not in HEADINGS and not dropped:
            self.regions[self.count] = tag
        self.open.append(Element(tag, self.count, dropped or inner_header, inner_header or (up is not None and up.heading_only and not kept_heading), said))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.said.append(" ")
        elif self.ends_line(tag):
            self.flush()

    def close_to(self, tag: str) -> None:
        while self.open:
            e = self.open.pop()
            self.links -= e.tag == "a"
            if e.tag == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.ends_line(tag):
            self.flush()
        if any(e.tag == tag for e in reversed(self.open)):
            self.close_to(tag)

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1].dropped):
            self.said.append(data)
            if self.links:
                self.linked += len(data)


def read_lines(page: str) -> tuple[list[Line], dict[int, str]]:
    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.flush()
    return reader.lines, reader.regions


def smoothed(ratios: list[float]) -> list[float]:
    weights = [math.exp(-((k / SIGMA) ** 2) / 2) for k in range(-REACH, REACH + 1)]
    total = sum(weights)
    edge = [ratios[0]] * REACH, [ratios[-1]] * REACH
    wide = [*edge[0], *ratios, *edge[1]]
    return [sum(w * x for w, x in zip(weights, wide[k : k + len(weights)], strict=True)) / total for k in range(len(ratios))]


def content_cluster(lines: list[Line], factors: list[float]) -> list[bool]:
    """Of each line, whether its smoothed ratio of text to tags, times its factor, is above the threshold: the deviation of
    the ratios of lines with factor 1. Linked text doesn't count."""
    ratios = smoothed([(len(x.text) - x.linked) / x.tags for x in lines])
    plain = [r for r, f in zip(ratios, factors, strict=True) if f == 1] or ratios
    mean = sum(plain) / len(plain)
    bound = math.sqrt(sum((r - mean) ** 2 for r in plain) / len(plain))
    above = [r * f > bound for r, f in zip(ratios, factors, strict=True)]
    return above if any(above) else [f == 1 for f in factors]


def total(lines: list[Line]) -> int:
    return sum(len(x.text) for x in lines)


def believed(lines: list[Line]) -> dict[int, str]:
    """The elements of which markup is to be believed, and what it says."""
    said = dict(s for x in lines for s in x.said)
    if not said:
        return said
    good = content_cluster(lines, [1.0] * len(lines))
    prose = [0 if x.heading or not inside else len(x.text) - x.linked for x, inside in zip(lines, good, strict=True)]
    top = next((k for k, x in enumerate(lines) if x.heading), -1)
    marked = [{n for n, _ in x.said} for x in lines]
    wrappers: set[int] = set()
    for element in sorted(said):  # outer elements have smaller numbers
        inside = [element in m for m in marked]
        free = [w if not here and m <= wrappers else 0 for w, here, m in zip(prose, inside, marked, strict=True)]
        held = sum(w for w, here in zip(prose, inside, strict=True) if here)
        first = inside.index(True)
        if held >= PROSE and WRAPS * sum(free) < held or top >= 0 and inside[top] and said[element] != "apart" and not any(free[:first]) or said[element] == "apart" and top >= 0 and inside[top] and held and not any(free):
            wrappers.add(element)
        elif said[element] == "layout":
            loose = [w if all(kind == "layout" for _, kind in x.said) else 0 for w, x in zip(prose, lines, strict=True)]
            if sum(loose) and 2 * sum(w for w, here in zip(loose, inside, strict=True) if here) >= sum(loose):
                wrappers.add(element)
    return {n: kind for n, kind in said.items() if n not in wrappers}


def region_of(lines: list[Line], cluster: list[Line], regions: dict[int, str], told: bool) -> int | None:
    """The element whose lines are the article; None for the whole page. told: whether the ratios set lines apart at all."""
    weight: dict[int, int] = {}
    around: dict[int, tuple[int, ...]] = {}
    for x in cluster:
        for depth, r in enumerate(x.inside):
            weight[r] = weight.get(r, 0) + len(x.text)
            around[r] = x.inside[: depth + 1]
    whole = total(cluster)
    region = max((r for r in weight if 10 * weight[r] >= 7 * whole), default=None)  # the innermost
    chain = around.get(region, ())
    for tag in REGIONS:
        if near := [r for r in chain if regions[r] == tag]:
            return near[-1]
        if inner := [r for r in weight if regions[r] == tag and 2 * weight[r] > whole and around[r][: len(chain)] == chain]:
            return max(inner, key=lambda r: (weight[r], -r))
    top = next((x for x in lines if x.heading and (region is None or region in x.inside)), None)
    for r in reversed(top.inside if top is not None and told else ()):
        if r == region:
            break
        others = [w for o, w in weight.items() if o not in top.inside and r not in around[o] and (region is None or region in around[o])]
        if weight.get(r, 0) >= max(others, default=whole):
            return r
    for up in reversed(chain[:-1]):
        beside = [x for x in lines if up in x.inside and region not in x.inside]
        if not beside or not all(x.heading for x in beside):
            break
        region = up
    return region


def main_text(page: str | None) -> str:
    lines, regions = read_lines(page or "")
    trusted = believed(lines)
    told = not all(content_cluster(lines, [1.0] * len(lines))) if lines else False
    lines = [x for x in lines if not any(trusted.get(n) == "apart" for n, _ in x.said)]
    factors = [0.1 if any(n in trusted for n, _ in x.said) else 1.0 for x in lines]
    strict = [any(trusted.get(n) == "strict" for n, _ in x.said) for x in lines]
    good = content_cluster(lines, factors) if lines else []
    kept = [x for x, inside, f, no in zip(lines, good, factors, strict, strict=True) if not no and (inside or f == 1)]
    region = region_of(kept, [x for x, inside, no in zip(lines, good, strict, strict=True) if inside and not no], regions, told)
    return "\n".join(x.text for x in kept if region is None or region in x.inside)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches):
        for b in batches:
            rows = b.column(1).to_pylist()
            texts = [main_text(r["html"]) for r in rows]
            yield batch_of(schema, [b.column(0), [r["url"] for r in rows], texts, [len(t) for t in texts]])

    value = F.struct(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return keyed(pages, id_col, value, "page_id", "page").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
