"""Statute XML to norms (SRC-1, SRC-2, TX-3, TX-5, TX-6, WN-1, WN-2)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import first_tag, let, norm_id, numeric_entities, squash, trim

# The entities of the source, the HTML element of each source element, and elements that are dropped.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "sect": "§", "para": "§", "deg": "°", "euro": "€", "eur": "€",
    "bdquo": "„", "ldquo": "“", "rdquo": "”", "sbquo": "‚", "lsquo": "‘", "rsquo": "’", "ndash": "–", "mdash": "—", "hellip": "…", "middot": "·", "times": "×", "minus": "−", "plusmn": "±", "frac12": "½", "frac14": "¼", "frac34": "¾", "sup2": "²", "sup3": "³", "Prozent": "%", "uArr": "⇑",
}
ELEMENTS = {
    "P": "p", "DL": "dl", "DT": "dt", "DD": "dd", "LA": "span", "BR": "br", "IT": "em", "B": "strong", "F": "em", "U": "u", "NB": "span", "Title": "h4", "table": "table", "thead": "thead", "tbody": "tbody", "row": "tr", "entry": "td", "pre": "pre",
    "Content": "div", "TOC": "div", "Revision": "span", "Ident": "span", "small": "small", "noindex": "span",
}
DROPPED = ("tgroup", "colspec", "FnR", "FnArea", "Footnotes", "Img", "kommentar")

ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
PIECE = re.compile(r"<(?P<tag>[^>]*)>|(?P<text>[^<]+)")


def decoded(text: str) -> str:
    """TX-3: entities decoded; unknown ones stay."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return ENTITIES.get(name, m[0])
        try:
            return chr(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))
        except (ValueError, OverflowError):
            return m[0]

    return ENTITY.sub(one, text)


def slim_html(xml: str | None) -> str:
    """TX-5: a norm's markup as slim HTML. Unknown and dropped elements lose their tags, not their text; open ones are closed."""
    out: list[str] = []
    stack: list[str] = []
    for m in PIECE.finditer(xml or ""):
        if m["text"] is not None:
            out.append(escape(decoded(m["text"]), quote=False))
            continue
        tag = m["tag"]
        if tag[:1] in ("!", "?"):
            continue
        closing, empty = tag.startswith("/"), tag.endswith("/")
        name, *rest = tag.strip("/").split(None, 1)[:2] or [""]
        attributes = rest[0] if rest else ""
        target = "" if name in DROPPED else ELEMENTS.get(name, "")
        if closing:
            closed = stack.pop() if stack else ""
            out.append(f"</{closed}>" if closed else "")
        elif not target:
            stack.extend([""] * (not empty))
        else:
            kind = ' class="sn"' if 'class="Rec"' in attributes else ""
            if name == "DL":
                found = re.search(r'Type="([^"]*)"', attributes)
                kind = f' class="gl gl-{found[1] if found and found[1] else "plain"}"'
            out.append(f"<{target}{kind}>")
            if target != "br" and not empty:
                stack.append(target)
    out.extend(f"</{x}>" for x in reversed(stack) if x)
    tidy = re.sub(r"<p>\s*</p>", "", re.sub(r"<span>\s*</span>", "", "".join(out)))
    return re.sub(r"[ \t]{2,}", " ", tidy).strip()


@F.pandas_udf(StringType())
def slim_html_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(slim_html)


def only_text(xml: Column) -> Column:
    """Text of an element, its entities and character references decoded; null gives an empty text."""
    def named(plain: Column) -> Column:
        for name, ch in ENTITIES.items():
            if name != "amp":
                plain = F.replace(plain, F.lit(f"&{name};"), F.lit(ch))
        return F.replace(numeric_entities(plain), F.lit("&amp;"), F.lit("&"))

    plain = F.regexp_replace(F.coalesce(xml, F.lit("")), "<[^>]+>", " ")
    return trim(squash(let(plain, lambda p: F.when(F.contains(p, F.lit("&")), named(p)).otherwise(p))))


def paragraphs(html: Column) -> Column:
    """WN-2: array of (n, html): a paragraph begins with a numbered <p>, and the <p> that follow belong to it."""
    pieces = F.filter(F.split(html, "(?=<p>)", -1), lambda t: trim(t) != "")
    number = lambda t: F.regexp_extract(t, r"\A<p>\s*\(?(\d+[a-z]?)\)\s*", 1)
    kind = "array<struct<n:string,html:string>>"

    def step(acc: Column, t: Column) -> Column:
        n = number(t)
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["n"].alias("n"), F.concat(last["html"], t).alias("html"))))
        fresh = F.struct(F.nullif(n, F.lit("")).alias("n"), F.when(n != "", F.regexp_replace(t, r"\A<p>\s*\(\d+[a-z]?\)\s*", "<p>")).otherwise(t).alias("html"))
        return F.when((n == "") & (F.size(acc) > 0), grown).otherwise(F.concat(acc, F.array(fresh))).cast(kind)

    found = F.aggregate(pieces, F.array().cast(kind), step)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("n"), html.alias("html"))).cast(kind)
    return F.when(F.size(found) > 0, found).otherwise(whole)


def read_folder(spark: SparkSession, path: str, statutes: DataFrame) -> DataFrame:
    """SRC-2: (abk, slug, titel, xml) of statutes (abk, slug, titel) from <slug>.xml; xml is null where the file is missing."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.xml").select(F.regexp_extract("_metadata.file_name", r"\A(.*)\.xml\z", 1).alias("slug"), F.col("value").alias("xml"))
    return statutes.join(files, "slug", "left")


#: What ends a record of a file; a reader that splits there gives any task a part of a file.
RECORD_END = "</norm>"


def _metadata(block: Column) -> Column:
    return F.coalesce(first_tag(block, "metadaten"), F.lit(""))


def _heading(block: Column) -> Column:
    meta = _metadata(block)
    return F.nullif(F.concat_ws(" ", *[F.nullif(only_text(first_tag(meta, tag)), F.lit("")) for tag in ("gliederungsbez", "gliederungstitel")]), F.lit(""))


def _build_date(xml: Column) -> Column:
    found = F.regexp_extract(xml, r'builddate="(\d{8})"', 1)
    return F.nullif(F.regexp_replace(found, r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3"), F.lit(""))


def _norms(rows: DataFrame) -> DataFrame:
    """Norms of rows (abk, slug, gesetz_titel, builddate, norm_seq, gliederung, b)."""
    rows = rows.withColumns({"enbez": only_text(first_tag(_metadata(F.col("b")), "enbez")), "titel": only_text(first_tag(_metadata(F.col("b")), "titel"))})
    content = first_tag(F.coalesce(first_tag(F.col("b"), "text"), F.lit("")), "Content")
    numbered = F.regexp_replace(content, r'<SUP class="Rec">(\d+)</SUP>', '<NB class="Rec">$1</NB>')
    note = only_text(first_tag(F.coalesce(first_tag(F.col("b"), "fussnoten"), F.lit("")), "Content"))
    rows = rows.withColumns({"html": slim_html_column(F.coalesce(numbered, F.lit(""))), "volltext": only_text(content), "fussnote": F.nullif(note, F.lit(""))})
    kept = rows.where((F.col("enbez") != "") & ~F.col("enbez").rlike("(?iu)\\AInhalts(?:übersicht|verzeichnis)\\z") & ((F.col("html") != "") | (F.col("titel") != "")))
    return kept.select("abk", "slug", "gesetz_titel", "builddate", "norm_seq", norm_id(F.col("enbez")).alias("norm_id"), "enbez", "titel", "gliederung", paragraphs(F.col("html")).alias("abs"), "fussnote", "volltext")


def parse(files: DataFrame) -> DataFrame:
    """SRC-1: one row for each norm of files (abk, slug, titel, xml), with the heading that it stands under.

    Blocks without a label, tables of contents and blocks with neither content nor title are no norms; headings of any
    block carry on to the norms behind it. A file is one row here; read_norms() takes files of any size.
    """
    blocks = F.regexp_extract_all("xml", F.lit(r"(?s)(<norm(?![A-Za-z0-9_]).*?</norm>)"), F.lit(1))
    rows = files.where("xml is not null").select("abk", "slug", F.col("titel").alias("gesetz_titel"), _build_date(F.col("xml")).alias("builddate"), F.posexplode(blocks).alias("norm_seq", "b"))
    w = Window.partitionBy("slug").orderBy("norm_seq").rowsBetween(Window.unboundedPreceding, 0)
    return _norms(rows.withColumn("gliederung", F.last(_heading(F.col("b")), ignorenulls=True).over(w)))


def read_norms(spark: SparkSession, path: str, statutes: DataFrame) -> DataFrame:
    """SRC-1, SRC-2: what parse() gives of the files <slug>.xml of statutes (abk, slug, titel), read record by record.

    A file is split where its records end, so it is many rows and, beyond the size of a split, many tasks. A record's
    place is its split and its order there. Two small tables, a row a split and a row a file, carry on the count of the
    records, the last heading and the build date; no window holds more than a split. What stands behind the last end of a
    record is none, as in a file that is cut off.
    """
    files = spark.read.option("lineSep", RECORD_END).text(path, pathGlobFilter="*.xml")
    slug = F.regexp_extract("_metadata.file_name", r"\A(.*)\.xml\z", 1)
    pieces = files.select(slug.alias("slug"), F.col("_metadata.file_block_start").alias("teil"), F.col("_metadata.file_size").alias("_bytes"), F.monotonically_increasing_id().alias("i"), "value")
    place = F.struct("teil", "i")
    of_file = pieces.groupBy("slug").agg(
        F.min_by(_build_date(F.col("value")), F.when(_build_date(F.col("value")).isNotNull(), place)).alias("builddate"),
        F.when(F.sum(F.octet_length("value") + len(RECORD_END)) != F.max("_bytes"), F.max(place)).alias("_rest"),  # no end behind the last piece
    )
    block = F.regexp_extract("value", r"(?s)(<norm(?![A-Za-z0-9_]).*)", 1)
    records = pieces.select("slug", "teil", "i", block.alias("_b")).where("_b <> ''").join(of_file, "slug").where(F.col("_rest").isNull() | (place != F.col("_rest")))
    records = records.select("slug", "teil", "i", "builddate", F.concat("_b", F.lit(RECORD_END)).alias("b"), _heading(F.col("_b")).alias("_kopf"))
    splits = records.groupBy("slug", "teil").agg(F.count("*").alias("_n"), F.max_by("_kopf", F.when(F.col("_kopf").isNotNull(), F.col("i"))).alias("_letzte"))
    before = Window.partitionBy("slug").orderBy("teil").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("slug", "teil", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_vorher"), F.last("_letzte", ignorenulls=True).over(before).alias("_offen"))
    inside = Window.partitionBy("slug", "teil").orderBy("i")
    rows = records.join(splits, ["slug", "teil"]).join(statutes.select("slug", "abk", F.col("titel").alias("gesetz_titel")), "slug")
    seq = (F.col("_vorher") + F.row_number().over(inside) - 1).cast("int")
    heading = F.coalesce(F.last("_kopf", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_offen")
    return _norms(rows.select("abk", "slug", "gesetz_titel", "builddate", seq.alias("norm_seq"), heading.alias("gliederung"), "b"))
