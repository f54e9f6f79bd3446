"""The crawl of handbooks against a single queue in plain Python."""

import random
import re
from urllib.parse import urljoin

import pytest

from lexgrain.plans import annotation_queries
from lexgrain.sources import crawl
from lexgrain.sources.staging import staged

PAGES, BOOKS = "url string, html string, end_url string", "abk string, prefix string, start string"
META = re.compile(r"/Meta/Inhalts(?:verzeichnis|uebersicht)/inhalt\.html$", re.I)


def by_queue(pages, prefix, start, limit=5000):
    """(last page, number of pages, sections, preliminary remarks) of one handbook; None if it has too many pages."""
    queue = list(dict.fromkeys([f"{prefix}Meta/Inhaltsverzeichnis/inhalt.html", f"{prefix}Meta/Inhaltsuebersicht/inhalt.html", start]))
    seen, sections, general, last, n = set(), {}, {}, None, 0
    while queue:
        if len(seen) > limit:
            return None
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        if url not in pages:
            continue
        html, end = pages[url]
        last, n = end or url, n + 1
        meta = META.search(last) or META.search(url)
        for href, label in re.findall(r'<a href="([^"]*)">(.*?)</a>', html):
            to = re.split("[?#]", urljoin(last, href))[0]
            if href.startswith("#") or not to.startswith(prefix) or not re.search(r"\.html$|/inhalt/?$", to):
                continue
            label = label.replace("&sect;", "§").replace("&nbsp;", " ")
            if found := re.match(r"§\s*(\d{1,4}[a-z]?)\b", label):
                sections.setdefault(found[1], (to, label))
                continue
            if found := re.match(r"Vor §§ (\d+) bis (\d+)", label):
                for k in range(int(found[1]), int(found[2]) + 1):
                    general.setdefault(str(k), (to, label))
            if not meta:
                queue.append(to)
        if meta and len(sections) >= 5:
            break
    return last, n, sections, general


def maps(spark, pages, books, **how):
    found = crawl.handbook_maps(spark.createDataFrame(pages, PAGES), spark.createDataFrame(books, BOOKS), staged, **how).collect()
    plain = lambda m: {k: tuple(v) for k, v in (m or {}).items()}
    return {r["abk"]: (r["start"], r["seiten"], plain(r["paragrafen"]), plain(r["vorschaltnormen"])) for r in found}


def site(seed, book):
    """A random graph of pages, some of them overviews, some reached under another address, some missing."""
    draw, prefix = random.Random(seed), f"https://h/{book}/"
    name = lambda k: f"{prefix}{k}/Meta/Inhaltsverzeichnis/inhalt.html" if k % 6 == 5 else f"{prefix}{k}.html"
    rows = []
    for k in draw.sample(range(30), 26):
        links = []
        for _ in range(draw.randrange(3, 9)):
            label = draw.choice(["Seite", "Seite", "Seite", f"§ {draw.randrange(1, 12)} Titel", f"&sect;&nbsp;{draw.randrange(1, 9)}a", "Vor §§ 3 bis 5", "§§ 7, 8"])
            links.append(f'<a href="{draw.choice([name(draw.randrange(30)), name(draw.randrange(30)), name(draw.randrange(30)), "/anders/x.html", "#oben", "bild.png", f"../{book}/{draw.randrange(30)}.html?x#y"])}">{label}</a>')
        rows.append((name(k), " ".join(links), f"{prefix}neu/{k}.html" if draw.random() < 0.1 else None))
    return rows, (str(book), prefix, name(0))


def test_maps_are_those_of_a_single_queue(spark):
    made = [site(seed, seed) for seed in range(24)]
    pages, books = [p for rows, _ in made for p in rows], [b for _, b in made]
    wanted = {b: by_queue({u: (h, e) for u, h, e in pages}, prefix, start) for b, prefix, start in books}
    got = maps(spark, pages, books)
    assert got == {b: w for b, w in wanted.items() if w[1]} and sum(len(w[2]) for w in wanted.values()) > 60


def test_the_order_of_the_visit_decides(spark):
    """z.html is visited before a.html; the overview with enough sections ends the crawl before late.html."""
    page = lambda *links: " ".join(f'<a href="{h}">{t}</a>' for h, t in links)
    pages = [
        ("https://h/s.html", page(("z.html", "weiter"), ("a.html", "weiter"), ("Meta/Inhaltsuebersicht/inhalt.html", "Übersicht")), None),
        ("https://h/z.html", page(("first.html", "§ 9 zuerst"), ("x/Meta/Inhaltsverzeichnis/inhalt.html", "weiter")), None),
        ("https://h/a.html", page(("second.html", "§ 9 danach"), ("late.html", "weiter")), None),
        ("https://h/x/Meta/Inhaltsverzeichnis/inhalt.html", page(*[(f"{k}.html", f"§ {k}") for k in range(1, 6)], ("nie.html", "weiter")), None),
        ("https://h/late.html", page(("spaet.html", "§ 77")), None),
    ]
    got = maps(spark, pages, [("h", "https://h/", "https://h/s.html")])["h"]
    assert got == by_queue({u: (h, e) for u, h, e in pages}, "https://h/", "https://h/s.html")
    assert got[2]["9"][0] == "https://h/first.html" and "77" not in got[2] and got[0] == "https://h/x/Meta/Inhaltsverzeichnis/inhalt.html"


def test_a_prefix_that_is_too_wide_has_no_map(spark):
    pages = [(f"https://h/{k}.html", f'<a href="{k + 1}.html">weiter</a> <a href="p.html">§ {k}</a>', None) for k in range(9)]
    books = [("weit", "https://h/", "https://h/0.html"), ("eng", "https://h/8", "https://h/8.html")]
    assert by_queue({u: (h, None) for u, h, _ in pages}, "https://h/", "https://h/0.html", limit=6) is None
    assert set(maps(spark, pages, books, max_pages=6)) == {"eng"}
    assert maps(spark, [], books) == {} and maps(spark, pages, []) == {}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_query_against_a_single_queue(spark, sf):
    pages, books = annotation_queries.handbook_site(spark, f"/root/testdata/{sf}")
    plain = {r["url"]: (r["html"].split("<!DOCTYPE")[0], None) for r in pages.collect()}
    wanted = {b["abk"]: by_queue(plain, b["prefix"], b["start"]) for b in books.collect()}
    got = {(r["abk"], r["nr"], r["vorschalt"]): (r["url"], r["titel"]) for r in annotation_queries.src06_section_map(spark, f"/root/testdata/{sf}").collect()}
    assert got and got == {(b, nr, bool(k)): x for b, w in wanted.items() for k in (0, 1) for nr, x in w[2 + k].items()}
