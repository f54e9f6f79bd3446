"""Main text of HTML pages by line-block distribution.

Markup is stripped, and every line of the page gets a weight: its characters, less those of links outside an article.
What a page says of its parts only changes weights: a line of an article weighs a full surge more, lines elsewhere weigh
less the more of the text the article holds, and a line in a menu, footer, advert and the like weighs nothing. Sums of
weights over sliding windows of lines then decide on every page: text surges where a window passes the threshold and
dives where one holds next to nothing; what lies between is kept, but for lines of no weight that are marked.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pack, unpack

# Elements whose content is never text; elements beside the article; elements that end a line.
SILENT = frozenset("script style noscript template svg math iframe object head title select button textarea canvas audio video".split())
BESIDE = frozenset("nav header footer aside dialog menu form".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCKS - {"br", "option", "legend", "caption", "html", "body", "tr", "td", "th", "tbody", "thead", "tfoot"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words of a class or id that mark an element beside the article, and words that such names also have.
MARKS = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup promo promoted promotion sponsor sponsored sponsors related recommended share sharing social sidebar widget menu navbar navigation nav footer header masthead pagination pager login search skip toolbar tags respond reply replies".split()
)
NEUTRAL = frozenset(
    "area bar block bottom box button buttons buttonbar col column container content feed form global group icons inner item items left link links list message module outer panel posts primary right row secondary section site slot sub thread top unit user wall wrap wrapper".split()
)
#: The marks that also count on a paragraph, heading or word inside an article.
ADVERTS = frozenset("ad ads advert adverts advertisement adsense promo promoted sponsor sponsored cookie cookies consent".split())
SMALL = frozenset("a b em h2 h3 h4 h5 h6 i li p small span strong td th tr blockquote figcaption".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Marks that say nothing inside an article.
TEXTUAL = frozenset("alert alerts search banner header masthead tags toolbar".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<)", re.S
)
#: Elements whose content isn't markup, and where each ends.
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?", re.S)
SPACES = re.compile(r"\s+")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]\w*")


@dataclass
class Part:
    """A run of text: whether it is link text, the marked elements and the articles around it, and whether a paragraph or heading holds it."""

    text: str
    link: bool
    marks: tuple[int, ...]
    articles: tuple[int, ...]
    prose: bool = False  # in a paragraph or heading


@dataclass
class Mark:
    """An element that its tag, role, class or id puts beside the article."""

    by_tag: bool
    advert: bool = False  # an advert or comments, by a class or id
    text: int = 0
    within: int = -1  # the innermost article around it


@dataclass
class Article:
    """An article, main or itemprop=articleBody element, the marked elements around it, and whether it is marked itself."""

    marks: tuple[int, ...]
    marked: bool
    text: int = 0


@dataclass
class Line:
    """A line of the page; text is empty if its marked elements hold all of it. prose: from a paragraph or heading."""

    text: str
    linked: int
    inside: bool
    prose: bool = False

    @property
    def own(self) -> int:
        """Characters; without those of links outside an article, and none there if most are."""
        if self.inside:
            return len(self.text)
        return max(0, len(self.text) - self.linked) if self.linked * 2 <= len(self.text) else 0


@dataclass(frozen=True)
class Windows:
    """The window that sums weights is `lines` lines; text surges where the sum passes `surge` characters, or half the highest sum if that is less; it dives where a whole window holds `dive` of that at most."""

    lines: int = 3
    surge: int = 80
    dive: float = 0.05


def names_mark(name: str, words: frozenset[str] = MARKS) -> bool:
    """Whether a class or id says that its element is beside the article: it has such a word, and no other that tells."""
    parts = [w.lower() for w in NAME_WORD.findall(name)]
    return any(w in words for w in parts) and all(w in MARKS or w in NEUTRAL or w[0].isdigit() for w in parts)


def mark_of(name: str, rest: str, within_article: bool) -> Mark | None:
    if name in BESIDE and not (name == "header" and within_article):
        return Mark(name != "form")
    if not rest or name in ("html", "body", "main", "h1"):
        return None
    attributes = {k.lower(): (a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(rest)}
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return Mark(False)
    words = (ADVERTS if name in SMALL else MARKS - TEXTUAL) if within_article else MARKS
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    found = any(names_mark(x, words) for x in named)
    return Mark(False, any(names_mark(x, ADVERTS | COMMENTS) for x in named)) if found else None


def parts_of(page: str) -> tuple[list[list[Part]], list[Mark], list[Article]]:
    """The lines of a page as parts once markup is stripped, its marked elements and its articles."""
    lines: list[list[Part]] = []
    parts: list[Part] = []
    marks: list[Mark] = []
    articles: list[Article] = []
    # name, silent, in a link, marked elements, articles, in a paragraph or heading
    stack: list[tuple[str, bool, bool, tuple[int, ...], tuple[int, ...], bool]] = []

    def state() -> tuple[bool, bool, tuple[int, ...], tuple[int, ...], bool]:
        return stack[-1][1:] if stack else (False, False, (), (), False)

    def end_line() -> None:
        if parts:
            lines.append(parts[:])
            parts.clear()

    at = 0
    while m := TOKEN.match(page, at):
        at = m.end()
        name = (m["name"] or "").lower()
        silent, link, marked, inside, prose = state()
        if m["text"] is not None:
            if not silent:
                parts.append(Part(html.unescape(m["text"]), link, marked, inside, prose))
        elif name and not m["close"]:
            if name in BLOCKS:
                end_line()
            if name in ENDS_P:
                open_p = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("p", *(("li",) if name == "li" else ())) or stack[i][0] in BLOCKS), None)
                if open_p is not None and (stack[open_p][0] == "p" or (name == "li" and stack[open_p][0] == "li")):
                    del stack[open_p:]
                    silent, link, marked, inside, prose = state()
            if name in VOID or m["rest"].rstrip().endswith("/"):
                continue
            mark = mark_of(name, m["rest"], bool(inside))
            if mark:
                mark.within = inside[-1] if inside else -1
                marked = (*marked, len(marks))
                marks.append(mark)
            if name in ("article", "main") or 'itemprop="articlebody"' in m["rest"].lower():
                inside = (*inside, len(articles))
                articles.append(Article(marked, mark is not None))
            prose = name in PROSE or prose and name not in BLOCKS
            stack.append((name, silent or name in SILENT, link or name == "a", marked, inside, prose))
            if name in RAW_END:
                end = RAW_END[name].search(page, at)
                at = end.start() if end else len(page)
        elif name:
            if name in BLOCKS:
                end_line()
            opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if opened is not None:
                del stack[opened:]
    end_line()
    return lines, marks, articles


def lines_of(page: str) -> list[Line]:
    """The lines of a page; what marked elements hold is no text of theirs.

    Of articles with text that aren't marked themselves, those within the fewest marked elements are the page's own. A mark
    doesn't count on an element around one of them, nor, unless a tag makes it, on one that holds most of the page's text
    where there is no own article, or most of its article's, adverts and comments excepted: class names, roles and
    forms that wrap everything say nothing.
    """
    lines, marks, articles = parts_of(page)
    whole = 0
    for line in lines:
        for p in line:
            n = len(p.text.strip())
            for k in p.articles:
                articles[k].text += n
            if not p.link:
                whole += n
                for k in p.marks:
                    marks[k].text += n
    depths = [len(x.marks) for x in articles if x.text and not x.marked]
    own = {k for k, x in enumerate(articles) if x.text and not x.marked and len(x.marks) == min(depths)}
    most = lambda x: x.text * 2 > (articles[x.within].text if x.within in own else whole)
    void = {k for a in own for k in articles[a].marks} | {k for k, x in enumerate(marks) if not x.by_tag and (not own or x.within in own and not x.advert) and most(x)}
    out = []
    for line in lines:
        if any(p.text.strip() for p in line):
            kept = [p for p in line if all(k in void for k in p.marks)]
            text = SPACES.sub(" ", "".join(p.text for p in kept)).strip()
            out.append(Line(text, sum(len(p.text) for p in kept if p.link), any(k in own for p in kept for k in p.articles), any(p.prose for p in kept)))
    return out


def weights_of(lines: list[Line], windows: Windows) -> list[float]:
    """A line of an article weighs a surge more than its text; the more the article holds, the less lines elsewhere weigh."""
    inside, whole = sum(x.own for x in lines if x.inside), sum(x.own for x in lines)
    rest = (1 - inside / whole) ** 2 if whole else 1.0
    return [x.own + windows.surge if x.inside and x.own else x.own * rest for x in lines]


def segments(lines: list[Line], windows: Windows = Windows()) -> list[tuple[int, int]]:
    """(first, last) of the lines of each stretch between dives, from its first surge to its last.

    A window that passes surges at its lines that weigh half of its heaviest or more, or pass by themselves. A stretch reaches on over the
    lines next to it that are prose too (a title, a date, a closing word), inside the article or outside as its end is.
    """
    weights, k = weights_of(lines, windows), windows.lines
    sums = [sum(weights[i : i + k]) for i in range(len(weights))]
    least = min(windows.surge, max(sums, default=0) / 2)
    dived = {i + d for i, s in enumerate(sums[: max(0, len(sums) - k + 1)]) if s <= windows.dive * least for d in range(k)}
    surges = sorted({i + d for i, s in enumerate(sums) if s > least for d, w in enumerate(weights[i : i + k]) if 2 * w >= max(weights[i : i + k]) or w > windows.surge} - dived)

    def belongs(i: int, edge: int) -> bool:
        return 0 <= i < len(lines) and i not in dived and weights[i] > 0 and lines[i].inside == lines[edge].inside and (lines[i].prose or lines[i].inside)

    found: list[tuple[int, int]] = []
    for i in surges:
        if found and not any(x in dived for x in range(found[-1][1], i)):
            found[-1] = (found[-1][0], i)
        else:
            found.append((i, i))
    out = []
    for first, last in found:
        while belongs(first - 1, first):
            first -= 1
        while belongs(last + 1, last):
            last += 1
        out.append((first, last))
    return out


def between_surge_and_dive(lines: list[Line], windows: Windows = Windows()) -> list[Line]:
    """The lines of the segments that have text."""
    return [x for first, last in segments(lines, windows) for x in lines[first : last + 1] if x.text]


def main_text(page: str | None, windows: Windows = Windows()) -> str:
    """The main text of a page: its blocks in order, one line each. Null and empty pages have none."""
    return "\n".join(x.text for x in between_surge_and_dive(lines_of(page or ""), windows))


def extract(pages: DataFrame, html_col: str = "html", windows: Windows = Windows()) -> DataFrame:
    """pages with text (empty if there is none) and n_chars, its code points.

    Each page is read whole and for itself: no shuffle, repeated rows give repeated rows, an empty table gives an
    empty one. White space inside a block becomes one space. Columns of pages named text or n_chars are replaced.
    """

    @F.pandas_udf("string")
    def text_of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, windows) for p in pages], dtype=object)

    found = pack(pages).withColumn("_text", text_of(F.col("_row").getField(html_col)))
    return unpack(found, pages.columns, text=F.col("_text"), n_chars=F.length("_text").cast("long"))
