"""Main text of web pages from streaming parser events.

The standard library's parser streams a page's events. Every block element starts a line; its
text-to-tag ratio is the number of its characters over its tags. The ratios of all lines are smoothed with a
Gaussian over neighbouring lines and split at a threshold into content and other lines. Each container then
scores the characters of its content lines less twice those of its other lines. Of the containers with content
lines the one with the best score is the content region, or the article around it; the page itself only where none
of its parts holds ``HELD`` of its content. All lines of the region are the main text, short ones too. A heading
counts as a content line if one follows within the reach of the smoothing.

What an element is weighs its text before the ratios are taken: text in elements that are never content (menus,
site headers, footers, sidebars, notices, adverts, forms, reader comments) weighs nothing, so its lines have the
ratio 0, and is no main text where it stands inside the region. Elements are such by tag or role, or by a name in
class or id. A name alone drops nothing: it marks the text, and ``dropped`` decides once the whole page is known.
Scripts, styles and embedded media are no text at all.

Defined results: null html counts as the empty page; a page without text outside such elements gives
the empty text; of containers with equal scores the innermost is the region; repeated rows stay repeated;
a very long page is read whole, in time linear in it but for unclosed quotes inside tags; an empty table gives an empty result; other
columns are ignored. Character references are decoded; white space in a line becomes one space; ``br`` is
white space.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Elements and names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
UNSEEN = frozenset("head script style noscript template svg iframe object canvas audio video".split())
VETOED = frozenset("nav aside footer form button select textarea menu dialog".split())
CONTAINER = frozenset("html body main article section div center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("main article".split())  # the region grows to such an element around it
CLOSES_P = BLOCK - {"html", "body"}
#: What keeps an end tag, or a new item, from closing an element outside of it; ``*`` is any block but ``p``.
NO_BARRIER, BLOCKS, BLOCKS_BUT_P = (), ("*", "p"), ("*",)
LISTS, TABLE = ("ul", "ol", "dl", "table", "select", "tbody", "tr"), ("table",)
SKIPPED_NAMES = re.compile(
    r"(?<![^\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|comments?|disqus|replies|menu|nav|navbar|navigation"
    r"|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|widget"
    r"|pagination|toolbar|login|signup)(?![^\s_-])",
    re.IGNORECASE,
)
COMMENT_NAMES = re.compile(r"(?<![^\s_-])(?:comments?|disqus|replies)(?![^\s_-])", re.IGNORECASE)
#: Words that leave a name beside them what it is (site-footer, comment-list); any other word makes it a
#: part of something else (has-sidebar, social-science).
QUALIFIERS = frozenset(
    "site page main primary secondary global top bottom left right upper lower inner outer side head foot body list item items box"
    " area section block wrapper wrap container content holder panel pane bar row column col slot unit zone region button"
    " buttons icon icons link links post posts article articles story stories news reader user thread form overlay message js id".split()
)
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())

#: Standard deviation of the smoothing, in lines; threshold as a share of the ratios' standard deviation.
SIGMA = 1.0
THRESHOLD = 0.5
#: A character outside content lines costs a container as much as this many inside gain it.
COST = 2.0
#: Part of the page's content that a part of it must hold to be the region in its stead.
HELD = 0.75


@lru_cache(maxsize=4096)
def name_mark(value: str) -> int:
    """What a class or id tells of its element: 0 nothing, 1 one of SKIPPED_NAMES in other company, 2 such a
    name by itself, 3 the name of reader comments by itself."""
    mark = 0
    for word in value.split():
        if SKIPPED_NAMES.search(word):
            rest = re.split(r"[_-]+", SKIPPED_NAMES.sub("", word).lower())
            alone = all(w in QUALIFIERS or len(w) < 2 or w.isdigit() for w in rest)
            mark = max(mark, 1 if not alone else 3 if COMMENT_NAMES.search(word) else 2)
    return mark


@dataclass
class Element:
    name: str
    number: int  # in order of their starts
    unseen: bool
    vetoed: bool
    named: int  # innermost named element, itself included, or 0
    container: int  # innermost container, itself included, or 0


@dataclass
class Line:
    pieces: list[tuple[int, bool, str]]  # innermost named element, whether vetoed, text
    tags: int
    container: int
    heading: bool

    def text(self, gone: set[int] | None = None) -> str:
        """What may be main text; with ``gone`` None all text."""
        return " ".join("".join(x for n, vetoed, x in self.pieces if gone is None or not vetoed and n not in gone).split())


class _Lines(HTMLParser):
    """Lines of a page, and its containers and named elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = [Element("", 0, False, False, 0, 0)]
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements by name
        self.unclosed = False  # whether a comment was met that has no end
        self.pages: set[int] = set()  # containers that are the page itself
        self.around: dict[int, int] = {}  # container: the one around it
        self.named: dict[int, tuple[int, int]] = {}  # mark, named element around
        self.whole: dict[int, tuple[str, int]] = {}  # main or article: name, innermost named element around
        self.ends: dict[int, int] = {}  # main or article: number of the last element in it
        self.lines: list[Line] = []
        self.pieces: list[tuple[int, bool, str]] = []
        self.tags = self.count = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)  # a bogus comment, as browsers read it
        return len(self.rawdata) if end < 0 else end + 1

    def parse_comment(self, i: int, report: int = 1) -> int:
        self.unclosed = self.unclosed or self.rawdata.find("-->", i + 4) < 0
        return -1 if self.unclosed else super().parse_comment(i, report)

    def end_line(self) -> None:
        if self.pieces:
            line = Line(self.pieces, max(1, self.tags), self.open[-1].container, any(e.name in HEADINGS for e in self.open[-3:]))
            if line.text():
                self.lines.append(line)
            self.pieces = []
        self.tags = 0

    def vetoed(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if self.open[-1].vetoed or tag in VETOED or tag == "header" and not any(self.places[name] for name in WHOLE):
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        return any(name == "role" and value is not None and value.lower() in SKIPPED_ROLES for name, value in attrs)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
        if tag == "br":
            self.handle_data(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.leave("p", BLOCKS_BUT_P)
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            self.leave(tag, TABLE if tag == "tr" else LISTS)
        self.count += 1
        inside, container = self.open[-1].named, self.open[-1].container
        vetoed = self.vetoed(tag, attrs)
        if tag in CONTAINER:
            self.around[self.count] = container
            container = self.count
            if tag in ("html", "body"):
                self.pages.add(container)
        if tag in WHOLE:
            self.whole[self.count] = tag, inside
        elif not vetoed and attrs and tag not in ("html", "body"):
            mark = max((name_mark(value) for name, value in attrs if value and name in ("class", "id")), default=0)
            if mark:
                self.named[self.count] = mark, inside
                inside = self.count
        for name in _places(tag):
            self.places[name].append(len(self.open))
        self.open.append(Element(tag, self.count, self.open[-1].unseen or tag in UNSEEN, vetoed, inside, container))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # only void elements close themselves

    def leave(self, tag: str, until: tuple[str, ...]) -> None:
        """Closes the innermost element of this name and all in it, unless one of ``until`` is in between."""
        if not self.places[tag]:
            return
        at = self.places[tag][-1]
        if any(self.places[name] and self.places[name][-1] > at for name in until):
            return
        while len(self.open) > at:
            closed = self.open.pop()
            for name in _places(closed.name):
                self.places[name].pop()
            if closed.name in WHOLE:
                self.ends[closed.number] = self.count

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag not in VOID:
            self.leave(tag, NO_BARRIER if tag in BLOCK or tag in UNSEEN or tag in VETOED else BLOCKS)

    def handle_data(self, data: str) -> None:
        inner = self.open[-1]
        if not inner.unseen:
            self.pieces.append((inner.named, inner.vetoed, data))


def _places(tag: str) -> tuple[str, ...]:
    """The names under which an open element is found."""
    return (tag, "*") if tag in BLOCK and tag != "p" else (tag,)


class _Articles:
    """How many articles lie beside an element: counted while elements are asked for in order of their starts.
    An article counts once the named element around it has begun, until that element is gone."""

    def __init__(self, parser: _Lines, whole: list[int], last: dict[int, int]):
        self.around = {n: parser.whole[n][1] for n in whole}
        self.coming = sorted(whole, key=lambda n: last[self.around[n]], reverse=True)
        self.opening = sorted(whole, reverse=True)
        self.ends = {n: parser.ends.get(n, parser.count) for n in whole}
        self.closing = sorted(whole, key=lambda n: self.ends[n], reverse=True)
        self.last = last
        self.by_element: dict[int, list[int]] = defaultdict(list)
        for n in whole:
            for element in {self.around[n], last[self.around[n]]}:
                self.by_element[element].append(n)
        self.gone: set[int] = set()
        self.counted: set[int] = set()
        self.open: set[int] = set()
        self.holding = 0  # of the counted ones, those that are open

    def beside(self, number: int) -> bool:
        while self.coming and self.last[self.around[self.coming[-1]]] < number:
            n = self.coming.pop()
            if not self.gone & {self.around[n], self.last[self.around[n]]}:
                self.counted.add(n)
                self.holding += n in self.open
        while self.opening and self.opening[-1] < number:
            n = self.opening.pop()
            self.open.add(n)
            self.holding += n in self.counted
        while self.closing and self.ends[self.closing[-1]] < number:
            n = self.closing.pop()
            if n in self.open:
                self.open.discard(n)
                self.holding -= n in self.counted
        return len(self.counted) > self.holding

    def drop(self, element: int) -> None:
        self.gone.add(element)
        for n in self.by_element.pop(element, ()):
            if n in self.counted:
                self.counted.discard(n)
                self.holding -= n in self.open


def smoothed(ratios: np.ndarray) -> np.ndarray:
    radius = int(3 * SIGMA)
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * SIGMA**2))
    return np.convolve(ratios, kernel / kernel.sum(), mode="full")[radius : radius + len(ratios)]


def clusters(sizes: np.ndarray, tags: list[int]) -> np.ndarray:
    """Which lines are content."""
    ratio = smoothed(sizes / np.array(tags))
    return ratio >= min(THRESHOLD * ratio.std(), ratio.max())


def dropped(parser: _Lines) -> set[int]:
    """The named elements that are never content and all named ones in them, judged from the outside in.

    One that holds a ``main`` stays. A name by itself drops its element if a main or article lies beside it,
    or if it does not hold most of the content lines' text (reader comments: all of it). In other company a
    name drops an element without an article most of whose text is not in content lines, and that does not
    hold most of the page's.
    """
    lines, named = parser.lines, parser.named
    shown = [line.text(set()) for line in lines]
    kept = [i for i, text in enumerate(shown) if text]  # vetoed text has no say in what names mean
    if not kept:
        return set()
    content = clusters(np.array([len(shown[i]) for i in kept], dtype=float), [lines[i].tags for i in kept])
    size: Counter = Counter()
    prose: Counter = Counter()  # of that, in content lines
    filled: set[int] = set()  # containers with text
    for i, is_content in zip(kept, content.tolist(), strict=True):
        for number, vetoed, data in lines[i].pieces:
            n = 0 if vetoed else len(" ".join(data.split()))
            size[number] += n
            prose[number] += n * is_content
        at = lines[i].container
        while at and at not in filled:
            filled.add(at)
            at = parser.around[at]
    whole = [n for n in parser.whole if n in filled]
    held: dict[int, set[str]] = defaultdict(set)
    for number in whole:
        name, around = parser.whole[number]
        held[around].add(name)
    for number in sorted(named, reverse=True):
        around = named[number][1]
        size[around] += size[number]
        prose[around] += prose[number]
        held[around] |= held[number]
    gone: set[int] = set()
    last = {0: 0}  # by named element: the innermost one around or itself with a name by itself
    for number in sorted(named):
        mark, around = named[number]
        last[number] = number if mark > 1 else last[around]
    articles = _Articles(parser, whole, last)
    for number in sorted(named):
        mark, around = named[number]
        if around in gone:
            gone.add(number)
            articles.drop(number)
            continue
        if not size[number] or "main" in held[number]:
            continue
        if mark > 1:
            beside = articles.beside(number)
            keep = not beside and (prose[number] == prose[0] if mark == 3 else 2 * prose[number] > prose[0])
        else:
            keep = "article" in held[number] or 2 * prose[number] >= size[number] or 2 * size[number] > size[0]
        if not keep:
            gone.add(number)
            articles.drop(number)
            size[0] -= size[number]
            prose[0] -= prose[number]
    return gone


def region(parser: _Lines, shown: list[str]) -> int:
    """The container with the best score, 0 if there is none. ``shown``: each line's text without what weighs
    nothing."""
    lines = parser.lines
    content = clusters(np.array([len(text) for text in shown], dtype=float), [line.tags for line in lines])
    for at in [i for i, line in enumerate(lines) if line.heading and shown[i]]:
        content[at] = content[at : at + 1 + int(3 * SIGMA)].any()
    score: Counter = Counter()
    gain: Counter = Counter()  # characters of content lines
    headings: Counter = Counter()
    for line, text, is_content in zip(lines, shown, content.tolist(), strict=True):
        score[line.container] += len(text) if is_content else -COST * len(line.text())
        gain[line.container] += len(text) * is_content
        headings[line.container] += line.heading and is_content and bool(text)
    for number in sorted(parser.around, reverse=True):  # inner ones first
        for sums in (score, gain, headings):
            sums[parser.around[number]] += sums[number]
    best = max((n for n in gain if gain[n]), key=lambda n: (score[n], n), default=0)
    if not gain[best]:
        return -1
    parts: dict[int, list[int]] = defaultdict(list)
    if best in parser.pages or not best:
        for number, around in parser.around.items():
            parts[around].append(number)
    while best in parser.pages or not best:
        largest = max(parts[best], key=lambda n: gain[n], default=None)
        if largest is None or gain[largest] < HELD * gain[best] or headings[largest] < headings[best]:
            break
        best = largest
    at, found = best, best
    while at:
        if at in parser.whole:
            found = at
        at = parser.around[at]
    return found


def main_text(html: str) -> str:
    parser = _Lines()
    # What begins after the last tag's end is text; the parser would look for an end from each such place.
    last = html.rfind(">") + 1
    parser.feed(html[:last] + html[last:].replace("<", "&lt;"))
    parser.close()
    parser.end_line()
    if not parser.lines:
        return ""
    gone = dropped(parser) if parser.named else set()
    shown = [line.text(gone) for line in parser.lines]
    chosen = region(parser, shown)
    inside = {chosen}
    for number in sorted(parser.around):
        if parser.around[number] in inside:
            inside.add(number)
    return "\n".join(text for line, text in zip(parser.lines, shown, strict=True) if text and line.container in inside)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per input row: key, the columns of ``keep`` as strings, and text."""

    def make():
        def row(r: dict):
            yield r["key"], *[r[f"k{i}"] for i in range(len(keep))], main_text(r["html"] or "")

        return row

    rows = pages.select(
        F.col(key).cast("bigint").alias("key"),
        *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keep)],
        F.col(html).cast("string").alias("html"),
    )
    names = ["key", *keep, "text"]
    schema = ", ".join(f"`{n}` {'bigint' if n == 'key' else 'string'}" for n in names)
    return map_rows(rows, make, schema, [pa.field(n, pa.int64() if n == "key" else pa.string()) for n in names])
