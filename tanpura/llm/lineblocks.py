"""Main text of web pages by line-block distribution.

The page is cut into lines at block-level tags. Lines of menus, headers, footers, sidebars, notices, adverts, forms
and comments (by element, role, or a word of class or id) are left out; a class or id doesn't count for an element that
encloses the page's only article or most of its text, nor, inside an article, for a paragraph, list item or other element
of text and for words that are only part of a class; elsewhere not for an element of text that is long enough to be the
article's. A heading in the header of a page without article and other heading is the page's. The lengths of the other lines, 0 for those that are mostly links,
are summed over windows of WINDOW lines: a surge is a line of text whose window's sum rises from 0, a dive is where the
sum falls back to 0. All lines between surge and dive are kept, for every stretch whose window reaches SURGE code points
(for the one with the most text, if none does).

Marks of an article adjust lengths and bounds only: where marked lines hold at least half of the text, the other lines'
lengths are 0, and what is kept of an article is extended to its ends. Otherwise (teasers in articles) marks aren't
used; what is kept of an element that holds lines (div, section, td) is extended to its first and last line of text.

A page is read once from left to right: its cost is in proportion to its length, however deep or broken the markup.

Defined cases: null html and pages without text give the empty text; bytes that aren't UTF-8 are replaced by U+FFFD; markup may be cut off anywhere, elements may be
unclosed; character references are decoded once, also those without a semicolon; repeated rows give repeated rows; an
empty table gives an empty result; other columns pass through, those named as outputs are replaced.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tanpura.llm.common import mapped

WINDOW, SURGE, LINKS, MOST = 3, 80, 0.5, 0.5

# HTML element names by role.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button title head".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
HOLDERS = frozenset("div section td article main".split())
TEXTUAL = frozenset("p li dd dt h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption td th span b i em strong".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
WORDS = (
    r"(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    r"sidebar|side-bar|rail|widget|footer|header|masthead|topbar|toolbar|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"comment|comments|disqus|replies|respond|related|recommended|share|sharing|social|pagination|pager|skip|copyright|legal|disclaimer)"
)
MARKS = re.compile(rf"(?:^|[\s_-])(?<!with[_-])(?<!has[_-])(?<!no[_-]){WORDS}(?:$|[\s_-])", re.IGNORECASE)
WHOLE = re.compile(rf"(?:^|\s){WORDS}(?:$|\s)", re.IGNORECASE)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comment|comments|reply|replies)(?:$|[\s_-])", re.IGNORECASE)
READERS = re.compile(r"(?:^|\s)(?:discussion|discussions|feedback|user-feedback|reader-feedback|responses|reader-responses)(?:$|\s)", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMES = frozenset("class id role hidden aria-hidden".split())
SPACE = re.compile(r"\s+")


#: Whether an element is boilerplate: no, for all it holds, by a word of class or id (and whether that is of comments).
NO, ALL, WORD, COMMENTS = range(4)
HEADER, TITLE = 1, 2


def boilerplate(name: str, attributes: str, inside: bool) -> int:
    """Whether an element is one of menus, adverts and the like. Attributes count by their own names.

    Inside an article a word counts if it is a whole class or the id (share, not market-share), and not for elements of
    text, whatever their length; comments count everywhere.
    """
    if name in BOILERPLATE:
        return ALL
    if not attributes or name in ("body", "html"):
        return NO
    found = [(key.lower(), a or b or c) for key, a, b, c in ATTRIBUTE.findall(attributes) if key.lower() in NAMES]
    if name in ARTICLE:
        return ALL if any(key in ("class", "id") and COMMENT.search(value) for key, value in found) else NO
    by = NO
    for key, value in found:
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return ALL
        if key in ("class", "id") and MARKS.search(value):
            if COMMENT.search(value):
                by = COMMENTS
            elif not inside or name not in TEXTUAL and WHOLE.search(value):
                by = max(by, WORD)
        elif key == "class" and name not in TEXTUAL and READERS.search(value):
            by = COMMENTS
    return by


class Line(NamedTuple):
    text: str
    linked: int  # code points in links
    bad: bool  # in boilerplate whatever the page holds
    mark: int  # place of the innermost mark, or -1
    article: int  # number of the outermost article, or 0
    holder: int  # number of the innermost of HOLDERS, or 0
    title: int  # whether it is in a h1: NO, in a header that is boilerplate and in no other (HEADER), elsewhere (TITLE)

    @property
    def length(self) -> int:
        return len(self.text) if self.linked <= LINKS * len(self.text) else 0


class Mark(NamedTuple):
    """An element that is boilerplate by class or id."""

    number: int
    kind: int
    textual: bool
    outer: int  # place of the mark that encloses it, or -1


class Open(NamedTuple):
    """An open element."""

    name: str
    kind: int
    number: int
    article: bool
    holder: int  # those outside it, to go back to
    mark: int
    barrier: int


def lines_of(page: str) -> tuple[list[Line], list[Mark]]:
    """The page's lines, and the elements that are boilerplate by class or id."""
    lines: list[Line] = []
    marks: list[Mark] = []
    stack: list[Open] = []
    open_now: dict[str, int] = {}
    unclosed: set[str] = set()  # skipped elements whose end tag doesn't come any more
    parts: list[str] = []
    articles: list[int] = []
    linked = bad = opened = holder = 0
    mark = barrier = -1  # barrier: place in the stack of the innermost p or element that ends one

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                title = NO if not open_now.get("h1") else TITLE if not bad else HEADER if bad == 1 and open_now.get("header") else NO
                lines.append(Line(text, linked, bad > 0, mark, articles[0] if articles else 0, holder, title))
            parts.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal bad, holder, mark, barrier
        for e in reversed(stack[i:]):
            bad -= e.kind == ALL
            open_now[e.name] -= 1
            if e.article:
                articles.pop()
        holder, mark, barrier = stack[i].holder, stack[i].mark, stack[i].barrier
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            parts.append(text)
            linked += len(text) if open_now.get("a") else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            end_line()
        if closing:
            if open_now.get(name):
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                close(i)
            continue
        if name in SKIPPED:
            if not attributes.endswith("/") and name not in unclosed:
                stop = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
                if stop:
                    at = stop.end()
                elif name in ("script", "style"):
                    at = n
                else:
                    unclosed.add(name)
            continue
        if name in CLOSES_P and barrier >= 0 and stack[barrier].name == "p":
            close(barrier)
        if name not in VOID and not attributes.endswith("/"):
            kind = boilerplate(name, attributes, bool(articles))
            if name == "header" and articles:
                kind = NO  # an article's own heading
            opened += 1
            article = name in ARTICLE and not kind
            stack.append(Open(name, kind, opened, article, holder, mark, barrier))
            open_now[name] = open_now.get(name, 0) + 1
            bad += kind == ALL
            if article:
                articles.append(opened)
            if name in HOLDERS:
                holder = opened
            if name == "p" or name in CLOSES_P:
                barrier = len(stack) - 1
            if kind in (WORD, COMMENTS):
                marks.append(Mark(opened, kind, name in TEXTUAL, mark))
                mark = len(marks) - 1
    end_line()
    return lines, marks


def without_boilerplate(lines: list[Line], marks: list[Mark]) -> list[Line]:
    """The lines outside boilerplate. Class and id don't count for elements that enclose the only article or most of the text, nor for long text."""
    # The heading of a page that has no article and no other may stand in the page's header.
    alone = not any(x.article or x.title == TITLE for x in lines)
    lines = [x for x in lines if not x.bad or alone and x.title == HEADER and x.length]
    if not marks:
        return lines
    text, held, article = [0] * len(marks), [0] * len(marks), [0] * len(marks)
    for x in lines:
        if x.mark >= 0:
            text[x.mark] += x.length
            held[x.mark] += 1
            article[x.mark] = max(article[x.mark], x.article)
    for i in range(len(marks) - 1, -1, -1):  # inner ones come later
        if (outer := marks[i].outer) >= 0:
            text[outer] += text[i]
            held[outer] += held[i]
            article[outer] = max(article[outer], article[i])
    total, rest = sum(x.length for x in lines), sum(x.length for x in lines if x.mark < 0)
    marked = any(x.article and x.mark < 0 for x in lines)
    counts: list[bool] = []
    for i, e in enumerate(marks):
        most = text[i] > MOST * total and text[i] >= SURGE and (e.kind == WORD or rest < SURGE) and (not marked or held[i] >= WINDOW)
        # An article that the element encloses, rather than one that encloses it, has the larger number.
        wraps = most or not marked and article[i] > e.number or e.textual and e.kind == WORD and text[i] >= SURGE
        counts.append(not wraps or e.outer >= 0 and counts[e.outer])
    return [x for x in lines if x.mark < 0 or not counts[x.mark]]


def main_text(page: str | None) -> str:
    """The main text: its lines joined by an empty line."""
    lines = without_boilerplate(*lines_of(page or ""))
    if not lines:
        return ""
    length = np.array([x.length for x in lines])
    article = np.array([x.article for x in lines])
    block = np.array([x.holder for x in lines])
    marked = article.any() and length[article > 0].sum() >= MOST * length.sum()
    if marked:
        length, block = np.where(article > 0, length, 0), article
    # The sum at i is that of lines i to i + WINDOW - 1, with empty lines after the last.
    sums = np.convolve(np.concatenate([length, np.zeros(WINDOW - 1, int)]), np.ones(WINDOW, int))[WINDOW - 1 :][: len(length)]
    stretches, surge = [], None
    for i, s in enumerate(sums):
        if surge is None and length[i]:
            surge = i
        if surge is not None and (not s or i == len(sums) - 1):
            stretches.append((surge, surge + int(np.flatnonzero(length[surge : i + 1])[-1])))
            surge = None
    reached = [r for r in stretches if sums[r[0] : r[1] + 1].max() >= SURGE]
    if not reached and stretches:
        reached = [max(stretches, key=lambda r: length[r[0] : r[1] + 1].sum())]
    kept = np.zeros(len(lines), bool)
    for first, last in reached:
        kept[first : last + 1] = True
    if marked:
        # An article without a surge has links only.
        kept = article > 0 if not reached else np.isin(article, article[kept & (article > 0)])
    else:
        for b in np.unique(block[kept & (length > 0) & (block > 0)]):
            own = block == b
            text = np.flatnonzero(own & (length > 0))
            kept[text[0] : text[-1] + 1] |= own[text[0] : text[-1] + 1]
    return "\n\n".join(x.text for x, k in zip(lines, kept, strict=True) if k)


def extract(pages: DataFrame, markup: str = "html") -> DataFrame:
    """pages without the markup, with text and n_chars."""
    def make(values: list[bytes]) -> list[pa.Array]:
        made = [main_text(v.decode("utf-8", "replace")) for v in values]
        return [pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())]

    return mapped(pages, markup, "text string, n_chars bigint", make)
