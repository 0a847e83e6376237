"""Main text of web pages: parser events, text-to-tag ratios, smoothing and a threshold."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventmill.llm.common import with_fields

_SKIPPED = frozenset("head title script style noscript template iframe object svg canvas math select textarea button".split())
_FURNITURE = frozenset("nav footer aside dialog menu".split())
_FURNITURE_NAME = re.compile(
    r"^(ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|footer|header|masthead|"
    r"cookies?|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|"
    r"comments?|commentlist|disqus|respond|related|recommended|widget\w*|pagination|pager|toolbar)$"
)
#: Parts of names that stand for a place; with one of the second set, or inside an article, it may be the text's own.
_PLACE = frozenset("header masthead banner side related".split())
_OF_TEXT = frozenset("article chapter content entry post section story text".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names that say whether a page has such a part.
_LAYOUT = re.compile(r"(?:^|(?<=[-_]))(?:has|no|with|without)[-_].*")
_FURNITURE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("html body main article section div td".split())
#: What an opening tag ends: the nearest open element of the set, unless one of the fence is nearer.
_CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_PARAGRAPH = (frozenset({"p"}), _CONTAINERS | {"li", "th", "blockquote", "nav", "aside", "footer", "header", "form", "dd", "figure"})
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark output q s samp small span strike strong sub sup time tt u var video audio picture".split())
_OPEN_TAG = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
#: What an unfinished tag looks like: a name, then attributes with values, of which the last may be cut.
_TAG_START = re.compile(r"""<(?:[!?]|/?([A-Za-z][A-Za-z0-9-]*)((?:\s+[A-Za-z_:@.-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'][^\s]*|"[^"]*\Z|'[^']*\Z|\Z))*)\s*/?(\s[A-Za-z-]*)?\Z)""")

#: Weights of a line and its two neighbours on each side: a normal curve of deviation 1.
_CURVE = [math.exp(-(d**2) / 2) for d in (-2, -1, 0, 1, 2)]
#: Marks of an element: none, furniture if it is mostly links, furniture unless it is most of the page, furniture, never seen.
_PLAIN, _PLACED, _LIKELY, _SURE, _UNSEEN = range(5)
#: A container is taken if it holds this share of the text that the threshold marked.
_SHARE = 0.8


class Marks(NamedTuple):
    """What the elements around a line say of it."""

    sure: int = _PLAIN  # _SURE or _UNSEEN if one of them is
    likely: tuple[int, ...] = ()  # numbers of the likely ones
    article: bool = False  # an article or main lies inside all marks

    def furniture(self, lifted: set[int], articles: bool) -> bool:
        """`lifted` marks do not count, nor do those around an article if `articles` lie in marked elements only."""
        if self.sure == _UNSEEN:
            return True
        return (self.sure == _SURE or not lifted.issuperset(self.likely)) and not (articles and self.article)


class Lines(HTMLParser):
    """Turns parser events into lines: text of a block, tags seen with it, and the containers it lies in."""

    def __init__(self, unclosed: frozenset[int] = frozenset()) -> None:
        """`unclosed` are the numbers of skipped elements without an end tag: the next block or other end tag ends them."""
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, Marks, int, bool, int]] = []  # name, marks from here on, container, in a link, number if skipped
        self.skipped = 0  # skipped elements so far
        self.unclosed = unclosed
        self.left_open: set[int] = set()
        self.parents = [-1]  # of containers; 0 is the page
        self.names = [""]  # of containers
        self.lines: list[tuple[str, int, Marks, int, int]] = []  # text, tags, marks, container, characters in links
        self.likely = 0  # likely marks so far
        self.placed: set[int] = set()  # those that only links make furniture
        self.text: list[str] = []
        self.tags = 0
        self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, marks, container, *_ = self.open[-1] if self.open else ("", Marks(), 0)
            self.lines.append((text, self.tags, marks, container, self.linked))
            self.tags = 0
        self.linked = 0
        self.text.clear()

    def _cut(self, at: int) -> None:
        """End the element at this place, and those inside it that have no end tag of their own."""
        self.left_open.update(number for *_, number in self.open[at + 1 :] if number)
        del self.open[at:]

    def _end_unclosed(self) -> None:
        for k, (*_, number) in enumerate(self.open):
            if number in self.unclosed:
                del self.open[k:]
                return

    def close(self) -> None:
        super().close()
        self.flush()
        self.left_open.update(number for *_, number in self.open if number)

    def _end(self, names: frozenset[str], fence: frozenset[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name in names:
                self._cut(k)
                return
            if name in fence:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in _BLOCK
        if block:
            self.flush()
            self._end_unclosed()
            self._end(*_PARAGRAPH)
            if tag in _CLOSES:
                self._end(*_CLOSES[tag])
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in _VOID:
            return
        _, marks, container, linked, _ = self.open[-1] if self.open else ("", Marks(), 0, False, 0)
        marks = self._marked(marks, tag, attrs)
        if tag in _CONTAINERS:
            self.parents.append(container)
            self.names.append(tag)
            container = len(self.parents) - 1
        self.skipped += tag in _SKIPPED
        self.open.append((tag, marks, container, linked or tag == "a", self.skipped if tag in _SKIPPED else 0))

    def _marked(self, marks: Marks, tag: str, attrs: list[tuple[str, str | None]]) -> Marks:
        if marks.sure == _UNSEEN:
            return marks
        if tag == "main":
            return Marks(article=True)
        if tag == "article":
            return marks._replace(article=True)
        own = self._mark(tag, attrs)
        if own in (_PLACED, _LIKELY):
            self.likely += 1
            if own == _PLACED:
                self.placed.add(self.likely)
            return Marks(marks.sure, (*marks.likely, self.likely), False)
        return Marks(own, marks.likely, False) if own else marks

    def _mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in _SKIPPED:
            return _UNSEEN
        inside = any(name in ("article", "main") for name, *_ in self.open)
        if tag in _FURNITURE or tag == "header" and not inside:
            mark = _SURE
        else:
            mark = _LIKELY if tag == "form" else _PLAIN
        if tag in ("html", "body"):
            return mark
        for name, value in attrs:
            if name in ("class", "id") and value:
                for word in value.lower().split():
                    parts = re.split(r"[-_]", _LAYOUT.sub("", word))
                    found = [part for part in parts if _FURNITURE_NAME.match(part)]
                    if found and _PLACE.issuperset(found) and tag in _HEADINGS:
                        continue  # a heading
                    if _FURNITURE_NAME.match(word):
                        mark = max(mark, _SURE)
                    elif found and _PLACE.issuperset(found) and (inside or not _OF_TEXT.isdisjoint(parts)):
                        mark = max(mark, _PLACED)
                    elif found:
                        mark = max(mark, _LIKELY)
            elif name == "role" and (value or "").lower() in _FURNITURE_ROLE:
                mark = max(mark, _SURE)
            elif name == "role" and (value or "").lower() == "form":
                mark = max(mark, _LIKELY)
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                mark = _UNSEEN
        return mark

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        self.tags += 1
        if self.unclosed and tag not in _INLINE:
            self._end_unclosed()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._cut(k)
                return
            if self.open[k][0] in ("article", "main", "body") and tag not in ("body", "html", "main", "article"):
                return  # an end tag without a start does not end the article

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in _SKIPPED:
            return
        self.text.append(data)
        if self.open and self.open[-1][3]:
            self.linked += len(data.strip())


def smoothed(ratios: list[float]) -> list[float]:
    out = []
    for i in range(len(ratios)):
        near = [(ratios[j], w) for j, w in zip(range(i - 2, i + 3), _CURVE, strict=True) if 0 <= j < len(ratios)]
        out.append(sum(r * w for r, w in near) / sum(w for _, w in near))
    return out


def main_text(html: str | None) -> str:
    """The article of a page: blocks of one line each, joined by an empty line; empty if there is none.

    Lines with much text for their tags, smoothed with their neighbours, are marked when they reach the deviation of all
    lines. The content is the innermost container that holds most of the marked text, widened to the article or main
    around it, or without one to the containers around it as long as what else is in them is no list of links. All of its
    lines that are no page furniture are kept, the short ones too, and so are the containers of marked lines elsewhere.
    Skipped elements without an end tag (a head, a button) end at the next block. A sign that begins no tag is text.
    """
    page = _parsed(html or "")
    lines = page.lines
    ratios = smoothed([len(text) / max(1, tags) for text, tags, *_ in lines])
    mean = sum(ratios) / max(1, len(ratios))
    bound = math.sqrt(sum((r - mean) ** 2 for r in ratios) / max(1, len(ratios)))
    furniture = _furniture(lines, [r >= bound for r in ratios], page.placed)
    plain = [k for k in range(len(lines)) if not furniture[k]]
    marked = [k for k in plain if ratios[k] >= bound] or plain
    weight = [0] * len(page.parents)
    for k in marked:
        at = lines[k][3]
        while at >= 0:
            weight[at] += len(lines[k][0])
            at = page.parents[at]
    # A container comes after its parent, so the last one with enough text is innermost.
    chosen = max((c for c, w in enumerate(weight) if w >= _SHARE * weight[0]), default=0)
    prose = [k for k in marked if 2 * lines[k][4] < len(lines[k][0])]  # smoothing marks links beside long text too
    whole = {_widened(page, chosen, plain, set(prose))}
    whole |= {_article(page, lines[k][3]) for k in prose} - {-1}
    around = set()  # their own lines count, not all that is in them
    for c in whole:
        while (c := page.parents[c]) >= 0:
            around.add(c)
    own = {lines[k][3] for k in prose}
    inside = [False] * len(page.parents)
    for c, parent in enumerate(page.parents):
        inside[c] = c in whole or parent >= 0 and inside[parent] or c in own and c not in around
    return "\n\n".join(lines[k][0] for k in plain if inside[lines[k][3]] or lines[k][3] in own)


def _without_cut_tag(html: str) -> str:
    """The page without a tag that its end cuts; a sign before other text stays as text."""
    last = _OPEN_TAG.search(html)
    if not last:
        return html
    tag = _TAG_START.match(html, last.start())
    name = (tag[1] or "").lower() if tag else ""
    known = name in _BLOCK | _VOID | _SKIPPED | _INLINE or name in ("html", "body", "option")
    if tag and (not name or known and not (len(name) == 1 and tag[3] and tag[3].strip() and not tag[2])):
        return html[: last.start()]
    return html[: last.start()] + "&lt;" + html[last.start() + 1 :]


def _parsed(html: str) -> Lines:
    """The lines of a page; once more with what the first pass found without an end tag, if there is any."""
    html = _without_cut_tag(html)
    unclosed: frozenset[int] = frozenset()
    for _ in range(2):
        page = Lines(unclosed)
        page.feed(html)
        page.close()
        if not page.left_open:
            break
        unclosed = frozenset(page.left_open)
    return page


def _furniture(lines: list[tuple[str, int, Marks, int, int]], high: list[bool], placed: set[int]) -> list[bool]:
    """A likely mark is lifted if its element holds most of the text of high ratio that is not furniture for sure.

    A `placed` one is lifted as well if less than half of its element's text is links.

    Articles in marked elements (a comment, a teaser) are furniture if the page has another article, else its text.
    """
    share: dict[int, int] = {}
    total = 0
    for (text, _, marks, _, _), counts in zip(lines, high, strict=True):
        if counts and marks.sure == _PLAIN:
            total += len(text)
            for mark in marks.likely:
                share[mark] = share.get(mark, 0) + len(text)
    lifted = {mark for mark, size in share.items() if size >= _SHARE * total}
    links = dict.fromkeys(placed, 0)
    for text, _, marks, _, linked in lines:
        for mark in placed.intersection(marks.likely):
            links[mark] += 2 * linked - len(text)
    lifted |= {mark for mark, more in links.items() if more < 0}
    articles = not any(marks.article and not marks.furniture(lifted, False) for _, _, marks, _, _ in lines)
    return [marks.furniture(lifted, articles) for _, _, marks, _, _ in lines]


def _article(page: Lines, at: int) -> int:
    """The outermost article or main around a container, -1 without one."""
    found = -1
    while at >= 0:
        if page.names[at] in ("article", "main"):
            found = at
        at = page.parents[at]
    return found


def _widened(page: Lines, chosen: int, plain: list[int], marked: set[int]) -> int:
    """The article around a container, or the farthest container up to which each part beside it is prose."""
    article = _article(page, chosen)
    if article >= 0:
        return article
    while (parent := page.parents[chosen]) >= 0:
        parts: dict[int, list[int]] = {}  # by child container, the parent for its own lines: marked lines, linked, all characters
        for k in plain:
            text, _, _, at, linked = page.lines[k]
            part = at
            while part > parent and page.parents[part] != parent:
                part = page.parents[part]
            if part >= parent and part != chosen:
                part_ = parts.setdefault(part, [0, 0, 0])
                part_[0] += k in marked
                part_[1] += linked
                part_[2] += len(text)
        if any(not m and 2 * linked >= size for m, linked, size in parts.values()):
            break
        chosen = parent
    return chosen


def extract_text(df: DataFrame, column: str = "html") -> DataFrame:
    """Add `text` (see `main_text`) and `n_chars`, its code points.

    NULL and empty pages have the empty text. Each row is worked on by itself, so repeated rows and empty tables need no
    care; extra columns stay, those named `text` or `n_chars` are replaced.
    """
    schema = with_fields(df.schema, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 500):
                frame = whole.iloc[at : at + 500]
                text = [main_text(h if isinstance(h, str) else "") for h in frame[column]]
                yield frame.assign(text=text, n_chars=[len(t) for t in text])[[f.name for f in schema.fields]]

    return df.mapInPandas(run, schema)
