"""The link frontier of a handbook over a table of pages (SRC-6, TX-18..21, FLT-5)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import links, page_text, section_number, section_range


# A page's base element, the relative prefixes that start at the host, and the overview pages of a handbook.
BASE = r"""(?is)<base(?![A-Za-z0-9_])[^>]*(?<![A-Za-z0-9_])href\s*=\s*(?:"([^"]+)"|'([^']+)'|([^\s>]+))"""
FROM_HOST = re.compile(r"(?:ao|esth|usth|ksth|gewsth|erbsth|grsth)/(?:\d{4}|\d{4}-\d{4})/", re.I)
NO_PAGE = re.compile(r"(?:javascript|mailto|tel):", re.I)
OVERVIEWS = ("Meta/Inhaltsverzeichnis/inhalt.html", "Meta/Inhaltsuebersicht/inhalt.html")
OVERVIEW = r"(?i)/Meta/Inhalts(?:verzeichnis|uebersicht)/inhalt\.html\z"
OTHER_HOST = ("//ao.bundesfinanzministerium.de/", "//amtliche-handbuecher.bundesfinanzministerium.de/")
ENOUGH_SECTIONS = 5


def resolved(base: str | None, href: str | None) -> str | None:
    h = AMPERSAND.sub("&", href or "").strip()
    if not h or h.startswith("#") or NO_PAGE.match(h):
        return None
    try:
        found = urljoin(base or "", f"/{h}" if FROM_HOST.match(h) else h)
        return found if urlsplit(found).scheme else None
    except ValueError:
        return None


AMPERSAND = re.compile("&amp;", re.I)


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """TX-21: a link's address; null for anchors, scripts, mail and telephone, and for what is no address."""
    return pd.Series([resolved(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def page_base(url: Column, html: Column) -> Column:
    """What a page's base element names, or null if it has none."""
    return F.nullif(F.concat(*[F.regexp_extract(html, BASE, k) for k in (1, 2, 3)]), F.lit(""))


def end_url(pages: DataFrame) -> Column:
    """Where a page was found after redirects."""
    return F.coalesce(*(F.col(c) for c in ("end_url", "url") if c in pages.columns))


def page_links(pages: DataFrame) -> DataFrame:
    """TX-20, TX-21: (von, seq, nach, beschriftung) for each link of pages (url, html), without query and fragment.

    Links are relative to the page's base element, itself relative to the page, or else to the page; the page stands at
    end_url, where pages have that column and it isn't null.
    """
    at = end_url(pages)
    base = F.coalesce(resolve(at, page_base(at, F.col("html"))), at)
    rows = pages.select("url", base.alias("_basis"), links(F.col("html")).alias("_links"))
    rows = rows.select(F.col("url").alias("von"), "_basis", F.posexplode("_links").alias("seq", "x"))
    rows = rows.select("von", "seq", resolve(F.col("_basis"), F.col("x.href")).alias("ziel"), page_text(F.col("x.label")).alias("beschriftung"))
    return rows.where("ziel is not null").select("von", "seq", F.regexp_extract("ziel", r"\A([^?#]*)", 1).alias("nach"), "beschriftung")


def prefixes(prefix: str) -> list[str]:
    """SET-6: the prefixes of a handbook's pages; one host stands for another, too."""
    return list(dict.fromkeys([prefix, prefix.replace(*OTHER_HOST)]))


def start_pages(handbooks: DataFrame) -> DataFrame:
    """SRC-6: (abk, seq, url): where the crawl of a handbook (abk, prefix, start) begins, each address once, in order."""
    own = F.array_distinct(F.array(F.col("prefix"), F.replace("prefix", F.lit(OTHER_HOST[0]), F.lit(OTHER_HOST[1]))))
    overviews = F.flatten(F.transform(own, lambda p: F.array(*[F.concat(p, F.lit(x)) for x in OVERVIEWS])))
    return handbooks.select("abk", F.posexplode(F.array_distinct(F.concat(overviews, F.array("start")))).alias("seq", "url"))


def is_internal(url: Column, prefixes: list[str] | Column) -> Column:
    """FLT-5: below an allowed prefix, and a page of text."""
    allowed = prefixes if isinstance(prefixes, Column) else F.array(*[F.lit(p) for p in prefixes])
    return F.exists(allowed, lambda p: F.startswith(url, p)) & F.regexp_extract(url, r"\A[a-z]+://[^/]+([^?#]*)", 1).rlike(r"(?i)\.html\z|/inhalt/?\z")


def reachable(all_links: DataFrame, starts: DataFrame, materialize) -> DataFrame:
    """SRC-6: (url, runde) of what is reached from starts (url): each round joins the frontier to the links.

    materialize(df) writes a round's table and reads it back, so the plan doesn't grow; a page is visited once.
    """
    seen = materialize(starts.select("url").distinct().withColumn("runde", F.lit(0)))
    frontier = seen
    for round_ in count(1):
        found = frontier.join(all_links, F.col("url") == F.col("von")).select(F.col("nach").alias("url")).distinct()
        frontier = materialize(found.join(seen.select("url"), "url", "left_anti").withColumn("runde", F.lit(round_)))
        if frontier.isEmpty():
            return seen
        seen = materialize(seen.unionByName(frontier))


#: Pages of a handbook that a crawl may see; beyond, its prefix is too wide, and it gets no map.
MAX_PAGES = 5000


@dataclass(frozen=True)
class Crawl:
    """What a crawl of handbooks saw.

    visits: (abk, url, end_url, runde, rang, gefunden, uebersicht), one row a visited address; links: (abk, runde, rang,
    seq, nach, beschriftung, nr), the internal links of the visited pages; too_wide: (abk) of handbooks with too many pages.
    """

    visits: DataFrame
    links: DataFrame
    too_wide: DataFrame


def _place(c: Column) -> Column:
    """A place in a list as text of fixed width, so that joined places sort as the visits go."""
    return F.lpad(F.hex(c.cast("long")), 6, "0")


def crawl(pages: DataFrame, handbooks: DataFrame, keep: Callable[[DataFrame], DataFrame], max_pages: int = MAX_PAGES, enough: int = ENOUGH_SECTIONS) -> Crawl:
    """SRC-6: breadth-first over all handbooks (abk, prefix, start) at once, in the order of a single queue for each.

    pages has (url, html) and may have end_url; each url once. A visit's rank is its round and, as text, the rank of
    the page that named it and the place of the link there, so no window over a handbook is needed. Links with a section
    number and links of overview pages aren't followed. A handbook ends at its first overview page at whose visit
    `enough` sections are known. keep(df) writes a round's table and reads it back: the plan doesn't grow.

    Defined results: a page that isn't in pages is visited, has no links and isn't counted as found; an address is
    visited once, where it is first named. A handbook without any page has visits but no map. A null address is never met.
    """
    own = F.array_distinct(F.array(F.col("prefix"), F.replace("prefix", F.lit(OTHER_HOST[0]), F.lit(OTHER_HOST[1]))))
    books = handbooks.select("abk", own.alias("prefixe"))
    found = pages.select("url", end_url(pages).alias("end_url"))
    named = keep(page_links(pages).select("von", "seq", "nach", "beschriftung", section_number(F.col("beschriftung")).alias("nr")))
    order = F.struct("runde", "rang")
    frontier = keep(start_pages(handbooks).select("abk", "url", F.lit(0).alias("runde"), _place(F.col("seq")).alias("rang"), F.lit(False).alias("zu_weit")))
    visits, links, wide, seen, firsts = [], [], [], Merged(keep), Merged(keep)
    for round_ in count(0):
        seen.add(frontier.select("abk", "url"))
        overview = F.col("end_url").isNotNull() & (F.col("url").rlike(OVERVIEW) | F.col("end_url").rlike(OVERVIEW))
        here = frontier.join(found, "url", "left").select("abk", "url", "end_url", "runde", "rang", F.col("end_url").isNotNull().alias("gefunden"), overview.alias("uebersicht"))
        out = here.join(named, F.col("url") == F.col("von")).join(books, "abk").where(is_internal(F.col("nach"), F.col("prefixe")))
        out = keep(out.select("abk", "runde", "rang", "uebersicht", "seq", "nach", "beschriftung", "nr"))
        firsts.add(out.where("nr is not null").groupBy("abk", "nr").agg(F.min(order).alias("o")))
        at = F.row_number().over(Window.partitionBy("abk").orderBy("o", "nr"))
        known = firsts.table().groupBy("abk", "nr").agg(F.min("o").alias("o")).withColumn("_k", at).where(F.col("_k") <= enough).where(F.col("_k") == enough)
        ends = here.where("uebersicht").join(known.select("abk", F.col("o").alias("_o")), "abk").where(order >= F.col("_o")).groupBy("abk").agg(F.min("rang").alias("_ende"))
        ends = keep(ends)
        within = F.col("_ende").isNull() | (F.col("rang") <= F.col("_ende"))
        visits.append(here.join(ends, "abk", "left").where(within).drop("_ende"))
        out = out.join(ends, "abk", "left").where(within)
        links.append(out.drop("_ende", "uebersicht"))
        fresh = out.where("_ende is null and nr is null and not uebersicht").groupBy("abk", F.col("nach").alias("url")).agg(F.min(F.struct("rang", "seq")).alias("x"))
        many = seen.table().groupBy("abk").agg(F.count("*").alias("n")).where(F.col("n") > max_pages).select("abk", F.lit(True).alias("_weit"))
        fresh = fresh.join(seen.table(), ["abk", "url"], "left_anti").join(many, "abk", "left")
        fresh = keep(fresh.select("abk", "url", F.lit(round_ + 1).alias("runde"), F.concat("x.rang", _place(F.col("x.seq"))).alias("rang"), F.coalesce("_weit", F.lit(False)).alias("zu_weit")))
        wide.append(fresh.where("zu_weit").select("abk"))
        frontier = fresh.where("not zu_weit")
        if frontier.isEmpty():
            return Crawl(*(reduce(DataFrame.unionByName, x) for x in (visits, links)), reduce(DataFrame.unionByName, wide).distinct())


class Merged:
    """Tables of several rounds as one; every eighth round they are written as one, so the plan stays short."""

    def __init__(self, keep: Callable[[DataFrame], DataFrame]):
        self.keep, self.parts = keep, []

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) == 8:
            self.parts = [self.keep(self.table())]

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def section_map(found: Crawl) -> DataFrame:
    """SRC-6: (abk, nr, url, titel, vorschalt): of each number the link that the crawl met first.

    vorschalt: numbers that a preliminary remark covers; a link with a number of its own covers none.
    """
    links = found.links.join(found.too_wide, "abk", "left_anti")
    place = [F.col(c) for c in ("runde", "rang", "seq")]
    own = links.where("nr is not null").select("abk", "nr", F.lit(False).alias("vorschalt"), F.struct(*place, F.lit(0).alias("i")).alias("o"), F.struct("nach", "beschriftung").alias("x"))
    rest = links.where("nr is null").select("abk", *place, F.posexplode(section_range(F.col("beschriftung"))).alias("i", "nr"), F.struct("nach", "beschriftung").alias("x"))
    general = rest.select("abk", "nr", F.lit(True).alias("vorschalt"), F.struct(*place, "i").alias("o"), "x")
    best = own.unionByName(general).groupBy("abk", "nr", "vorschalt").agg(F.min_by("x", "o").alias("x"))
    return best.select("abk", "nr", F.col("x.nach").alias("url"), F.col("x.beschriftung").alias("titel"), "vorschalt")


def handbook_maps(pages: DataFrame, handbooks: DataFrame, keep: Callable[[DataFrame], DataFrame], **how) -> DataFrame:
    """SRC-6: (abk, start, seiten, paragrafen, vorschaltnormen): the map of each handbook, by number; start is the page read last.

    A handbook's map is one row, as published; section_map() has it as rows.
    """
    found = crawl(pages, handbooks, keep, **how)
    seen = found.visits.where("gefunden").join(found.too_wide, "abk", "left_anti").groupBy("abk").agg(F.max_by("end_url", F.struct("runde", "rang")).alias("start"), F.count("*").alias("seiten"))
    entry = F.struct("nr", F.struct("url", "titel"))
    part = lambda when: F.map_from_entries(F.array_sort(F.collect_list(F.when(when, entry))))
    maps = section_map(found).groupBy("abk").agg(part(~F.col("vorschalt")).alias("paragrafen"), part(F.col("vorschalt")).alias("vorschaltnormen"))
    return seen.join(maps, "abk", "left")
