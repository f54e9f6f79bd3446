"""Text functions on columns. All are built-in expressions, so they stay inside the JVM and prune and push down as usual.

Patterns follow ECMAScript: white space includes the no-break and typographic spaces, and a word boundary looks at
ASCII letters, digits and underscores alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

#: White space and word boundary of ECMAScript, for Java's patterns. Most characters fail at the first two tests.
S = r"[\t-\r [\x{A0}-\x{FEFF}&&[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"
NS = S.replace("[", "[^", 1)
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: The same boundary before and behind an ASCII letter or digit: far cheaper to test at every place of a text.
BS, BE = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: The same in patterns that ignore case, for which four more characters are letters of the ASCII range; the class itself is faster with case.
BSI, BEI = "(?<!(?-i:[A-Za-z0-9_]))(?<![İıſK])", "(?!(?-i:[A-Za-z0-9_]))(?![İıſK])"
#: The characters of S; those that aren't ASCII.
WIDE_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACES = "\t\n\x0b\f\r " + WIDE_SPACES
WIDE = S.replace(r"\t-\r ", "")
I = "(?iu)"  # noqa: E741

# What ends a line of a page, what is no text of it, a link; the parts of phrases that are compared as one
# sign; dates and gazettes; ranges of sections.
LINE_BREAK = r"(?i)<(?:br|hr)(?![A-Za-z0-9_])[^>]*>"
LINE_END = r"(?i)</(?:p|div|li|h[1-6]|section|article|tr|td|th)>"
BOILERPLATE = ("script", "style", "nav")
LINK = r"""(?is)<a(?![A-Za-z0-9_])[^>]*(?<![A-Za-z0-9_])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))[^>]*>(.*?)</a>"""
SECTION_REFERENCE = rf"§+{S}*\d+[a-z]?(?:{S}*(?:abs(?:atz|\.)|satz|nummer|nr\.|buchst(?:abe|\.)){S}*\d+[a-z]?)*"
NUMBER = rf"\d(?<={BS}\d)[\d.,]*{B}"
PHRASE_MARKS = "[\"»«(),;:.]"
MARKED_PHRASE = "[§„\"»«(),;:.]"
TIME_ONLY = rf"{I}{BSI}(?:\d{{1,2}}\.{S}?(?:{'|'.join(W.MONTHS)}){S}?\d{{4}}{BEI}|Veranlagungszeitraum{S}?\d{{4}}{BEI}|ab{S}?\d{{4}}{BEI}|BGBl\.|BStBl\.)"
SECTION_SPAN = rf"(\d{{1,4}})[a-z]?{S}*(?:bis|-|–){S}*(\d{{1,4}})[a-z]?"

sub = F.regexp_replace


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row: a lambda variable, which the optimizer never inlines.

    The variable is the start of an aggregate over nothing. An element of a transformed array would do too, but its result is
    copied, and its type and nullability are worked out from the whole body for each row.
    """
    return F.aggregate(F.array(), value, lambda held, _: held, body)


def bind(body, **values: Column) -> Column:
    """body of a struct of the values, each evaluated once."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def first_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key, in order. Keys are sorted with their places, so work isn't quadratic."""
    placed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
    first = lambda p: F.filter(F.transform(p, lambda x, i: F.when((i == 0) | ~x["k"].eqNullSafe(F.get(p, i - 1)["k"]), x["i"])), lambda i: i.isNotNull())
    return let(let(placed, first), lambda at: F.transform(F.sort_array(at), lambda i: F.get(items, i)))


def settled(df, *computed: str):
    """df with its computed columns behind a generator of one row a row.

    A filter on a computed column is pushed down by copying the column's whole expression, and so are those of all
    columns that it is made of; through a generator's output it isn't, so long chains of columns stay as long as they are.
    """
    kept = [c for c in df.columns if c not in computed]
    return df.select(*kept, F.explode_outer(F.array(F.struct(*computed))).alias("_settled")).select(*kept, "_settled.*")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def any_of(c: Column, *needles: str) -> Column:
    """Whether c holds one of the needles; far cheaper than a pattern, and most texts hold none."""
    return reduce(Column.__or__, [F.contains(c, F.lit(x)) for x in needles])


def folded(c: Column) -> Column:
    """c in lower case as patterns that ignore case compare it: a text that has a cue has it here in small letters."""
    letters = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}
    plain = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(letters[x])), letters, c)
    return F.lower(F.when(beyond_ascii(c) & any_of(c, *letters), plain).otherwise(c))


def beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.length(c)


def ends_in(c: Column, first: str, last: str) -> Column:
    """Whether c begins with one of the first characters or ends in one of the last; true for an empty text. Trimming costs far more, and few texts need it."""
    held = lambda chars, at: F.contains(F.lit(chars), F.substring(c, at, 1))
    return reduce(Column.__or__, [held(chars, at) for chars, at in ((first, 1), (last, -1)) if chars])


def trim(c: Column) -> Column:
    return let(F.trim(c), lambda c: F.when(ends_in(c, SPACES, SPACES), F.btrim(c, F.lit(SPACES))).otherwise(c))


def unsquashed(c: Column) -> Column:
    """Whether c has white space other than single spaces."""
    return any_of(c, "  ", "\t", "\n", "\x0b", "\f", "\r") | (beyond_ascii(c) & c.rlike(WIDE))


def squash(c: Column) -> Column:
    """Runs of white space become one space; single spaces, which most are, aren't touched."""
    return let(c, lambda c: F.when(unsquashed(c), sub(c, rf"{S}{{2,}}|(?! ){S}", " ")).otherwise(c))


def _closed_up(c: Column, marks: str) -> Column:
    return let(c, lambda c: F.when(c.rlike(f" [{marks}]"), sub(c, f" ([{marks}])", "$1")).otherwise(c))


def tidy(c: Column) -> Column:
    """No white space before a punctuation mark. Takes squashed text."""
    return _closed_up(c, ",.:;!?")


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, rf"{S}+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    """As many as splitting at white space gives, so an empty text counts as one."""
    return let(c, lambda c: F.when(unsquashed(c), F.regexp_count(c, F.lit(rf"{S}+")) + 1).otherwise(n_spaces(c) + 1))


def more_words(c: Column, most: int) -> Column:
    """n_words(c) > most. Long texts are told by their first words: up to that many single spaces, with no other white space before them."""
    head = F.substring_index(c, " ", most)
    return bind(lambda x: F.when((F.octet_length(x["h"]) < F.octet_length(x["c"])) & ~unsquashed(F.concat(x["h"], F.lit(" "))), True).otherwise(n_words(x["c"]) > most), c=c, h=head)


def n_spaces(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def first_word(c: Column) -> Column:
    """What splitting at white space gives first."""
    return F.regexp_extract(c, rf"\A{NS}*+", 0)


# HTML ----------------------------------------------------------------------------------------------------------


def strip_markup(html: Column) -> Column:
    """TX-1: the canonical text of a norm's HTML; sentence numbers go with their content."""
    marked = lambda c: sub(sub(c, r'(?is)<span[^>]*class="[^"]*(?<![A-Za-z0-9_])sn(?![A-Za-z0-9_])[^"]*"[^>]*>.*?</span>', ""), "<[^>]+>", " ")
    c = let(_text(html), lambda c: F.when(F.contains(c, F.lit("<")), marked(c)).otherwise(c))
    named = lambda c: F.replace(F.replace(F.replace(c, F.lit("&sect;"), F.lit("§")), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return trim(tidy(squash(let(c, lambda c: F.when(F.contains(c, F.lit("&")), named(c)).otherwise(c)))))


def code_point(c: Column) -> Column:
    """The character of a code point in hexadecimal digits; null for surrogates and beyond the Unicode range."""
    valid = ~c.rlike(r"(?i)\A0*(?:d[89a-f][0-9a-f]{2}|(?:1[1-9a-f]|[2-9a-f][0-9a-f])[0-9a-f]{4})\z")
    return F.when(valid, F.decode(F.unhex(F.lpad(c, 8, "0")), "UTF-32"))


def numeric_entities(c: Column) -> Column:
    """Decimal and hexadecimal character references of any length, decoded; what is no character stays."""
    pattern = r"&#([xX][0-9a-fA-F]+|[0-9]+);"

    def one(x: Column) -> Column:
        bare = lambda c, most: F.when(F.length(c) <= most, c)
        hexadecimal, decimal = (sub(c, r"\A0+(?=.)", "") for c in (F.substring(x, 2, 2**31 - 1), x))
        digits = F.when(F.startswith(F.lower(x), F.lit("x")), bare(hexadecimal, 6)).otherwise(F.conv(bare(decimal, 7), 10, 16))
        return F.coalesce(let(digits, code_point), F.concat(F.lit("&#"), x, F.lit(";")))

    def woven(c: Column, pieces: Column, decoded: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(decoded, i), F.lit("")))), "")

    def replaced(c: Column) -> Column:
        decoded = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), one)
        return F.when(F.contains(c, F.lit("&#")), let(decoded, lambda d: let(F.split(c, pattern, -1), lambda p: woven(c, p, d)))).otherwise(c)

    return let(c, replaced)


def decode_entities(c: Column) -> Column:
    """The entities of handbook pages; unknown ones stay, soft hyphens go."""
    def named(c: Column) -> Column:
        for pattern, to in W.HANDBOOK_ENTITIES:
            c = sub(c, pattern, to)
        return numeric_entities(c)

    return F.replace(let(c, lambda c: F.when(F.contains(c, F.lit("&")), named(c)).otherwise(c)), F.lit("\u00ad"), F.lit(""))


def page_text(html: Column) -> Column:
    """TX-2: one line of text from HTML."""
    return trim(squash(decode_entities(sub(_text(html), "<[^>]+>", " "))))


def page_lines(html: Column) -> Column:
    """TX-2: the non-empty lines of HTML, block ends and breaks being line ends; an array."""
    c = sub(sub(_text(html), LINE_BREAK, "\n"), LINE_END, "\n")
    c = F.replace(decode_entities(sub(c, "<[^>]+>", " ")), F.lit("\r"), F.lit(""))
    return F.filter(F.transform(F.split(c, "\n"), lambda x: trim(squash(x))), lambda x: x != "")


def first_tag(c: Column, tag: str) -> Column:
    """TX-4: the content of the first element of that name; null if there is none."""
    pattern = rf"(?is)<{tag}(?:{S}[^>]*)?>(.*?)</{tag}>"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def drop_boilerplate(html: Column) -> Column:
    """TX-24: without scripts, styles and navigation."""
    c = _text(html)
    for tag in BOILERPLATE:
        c = sub(c, rf"(?is)<{tag}.*?</{tag}>", "")
    return c


def links(html: Column) -> Column:
    """TX-20: array of (href, label) of the links of a page, in order."""
    def group(k: int) -> Column:
        return F.regexp_extract_all(html, F.lit(LINK), F.lit(k))

    href = F.zip_with(F.zip_with(group(1), group(2), lambda a, b: F.concat(a, b)), group(3), lambda a, b: F.concat(a, b))
    return F.arrays_zip(href.alias("href"), group(4).alias("label"))


def escape_html(c: Column) -> Column:
    """TX-32."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return let(_text(c), lambda c: F.when(any_of(c, "&", "<", ">"), escaped(c)).otherwise(c))


def truncate(c: Column, most: int, marks: tuple[str, ...] = (". ", "; ")) -> Column:
    """TX-16: at most `most` characters, cut behind the last mark in the second half if there is one."""
    cut = F.substring(c, 1, most)
    ends = [F.when(F.instr(cut, m) > 0, F.lit(most + 1) - F.instr(F.reverse(cut), m[::-1]) - len(m) + 1).otherwise(0) for m in marks]
    end = F.greatest(*ends) if len(ends) > 1 else ends[0]
    kept = F.when(end - 1 > most * 0.5, F.substring(cut, F.lit(1), end)).otherwise(cut)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(trim(kept), F.lit(" […]")))


# Spans ---------------------------------------------------------------------------------------------------------


def span_text(c: Column) -> Column:
    """TX-13: white space collapsed, punctuation tidied, leading and trailing marks off."""
    marks, stop = SPACES + ",;:", SPACES + ",;:."
    return let(tidy(squash(_text(c))), lambda c: F.when(ends_in(c, marks, stop), F.rtrim(F.ltrim(c, F.lit(marks)), F.lit(stop))).otherwise(c))


def clean_span(c: Column) -> Column:
    """TX-14: a cut piece of a sentence, without a conjunction left hanging at its end."""
    hanging = rf"{I}[,;]?{S}+(?:wenn|soweit|sofern|falls|und|oder|sowie|dass)\z"
    c = let(squash(_text(c)), lambda c: F.when(any_of(c, ",,", ", ,"), sub(c, rf",{S}*,+", ",")).otherwise(c))
    unmarked = lambda c: sub(sub(c, rf"\A[,;:]{S}*", ""), r"[.,;:]\z", "")
    c = let(trim(_closed_up(c, ",.;")), lambda c: F.when(ends_in(c, ",;:", ".,;:"), unmarked(c)).otherwise(c))
    ends = lambda c: F.contains(F.lit("ntsrdeNTSRDE\u017f"), F.right(c, F.lit(1)))
    return trim(let(c, lambda c: F.when(ends(c) & F.substring(c, -8, 8).rlike(hanging), sub(c, hanging, "")).otherwise(c)))


def has_content(c: Column) -> Column:
    """TX-15: four characters and a word of four letters that carries meaning; a lone verb has none. The search ends at the first such word."""
    letter, empty = "[a-zäöüß]", "|".join(w for w in (*W.FINITE, *W.FILLERS) if len(w) >= 4)
    meant = rf"(?<!{letter})(?!(?:{empty})(?!{letter})){letter}{{4}}"
    return let(c, lambda c: F.coalesce((F.length(c) >= 4) & F.lower(c).rlike(meant), F.lit(False)))


def phrase_key(c: Column, least: int = 2, most: int = 8) -> Column:
    """TX-12: the form in which phrases are compared; null outside least to most words.

    Without a mark or a section a text has as many words as its form, so most texts are told to be too long before any pattern runs.
    """
    def short(c: Column, form: Column) -> Column:
        return let(F.when(c == "", 0).otherwise(n_spaces(c) + 1), lambda n: F.when((n >= least) & (n <= most), form))

    def unmarked(c: Column) -> Column:
        c = sub(sub(F.lower(c), SECTION_REFERENCE, "§"), NUMBER, "#")
        c = sub(F.replace(c, F.lit("„"), F.lit(" ")), PHRASE_MARKS, " ")
        return let(F.trim(squash(c)), lambda c: short(c, c))

    return let(F.trim(squash(_text(c))), lambda c: F.when(c.rlike(MARKED_PHRASE), unmarked(c)).otherwise(short(c, sub(F.lower(c), NUMBER, "#"))))


def tokens(c: Column) -> Column:
    """TX-17: the set of words of three letters or more, without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(_text(c)), F.lit("([a-zäöüß0-9]{3,})"), F.lit(1))), F.lit(list(W.STOP_WORDS)))


def overlap(a: Column, b: Column) -> Column:
    """SET-3: shared tokens over those of the smaller set; 0 if either is empty. Takes token arrays."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def quality(c: Column) -> Column:
    """MRG-5: how clean a span is, from 0 to 1."""
    words = let(n_words(trim(c)), lambda n: F.when(n < 3, 0.75).otherwise(1.0) - F.when(n > 30, 0.2).otherwise(0.0))
    points = words - F.when(F.contains(c, F.lit(";")), 0.1).otherwise(0.0) - F.when(F.contains(F.lower(c), F.lit("oder")) & c.rlike(rf"(?is){B}und{B}.*{B}oder{B}"), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), points))


def time_only(c: Column) -> Column:
    """TX-26: a date, assessment period or gazette reference and fewer than twelve other word characters."""
    def rest(c: Column) -> Column:
        return let(F.split(c, TIME_ONLY, 2), lambda p: (F.size(p) == 2) & (F.length(sub(F.array_join(p, ""), r"[^A-Za-z0-9_äöüßÄÖÜ]", "")) < 12))

    # each of the forms has a year or a gazette, which most texts lack
    return F.coalesce(let(c, lambda c: (c.rlike(r"\d{4}") | let(folded(c), lambda x: any_of(x, "bgbl", "bstbl"))) & rest(c)), F.lit(False))


def junctor(texts: Column, intro: Column) -> Column:
    """TX-25: "und" or "oder" between the entries of a list; null for fewer than two."""
    last, before = F.coalesce(F.element_at(texts, -1), F.lit("")), F.coalesce(F.try_element_at(texts, F.lit(-2)), F.lit(""))
    intro = _text(intro)
    return (
        F.when(F.size(texts) < 2, F.lit(None).cast("string"))
        .when(before.rlike(rf"{I}{B}und{S}*\z") | last.rlike(rf"{I}\Aund{B}"), "und")
        .when(before.rlike(rf"{I}{B}oder{S}*\z") | last.rlike(rf"{I}\Aoder{B}"), "oder")
        .when(intro.rlike(rf"{I}{B}kumulativ{B}|{B}sämtliche{B}|{B}allen{B}|{B}folgende Voraussetzungen{B}"), "und")
        .otherwise("oder")
    )


# Labels --------------------------------------------------------------------------------------------------------


def section_number(label: Column) -> Column:
    """TX-18: the number of a label "§ n"; null for ranges and preliminary remarks. Takes plain text."""
    found = F.regexp_extract(label, rf"\A§{S}*(\d{{1,4}}[a-z]?){B}", 1)
    return F.when(label.rlike(rf"{I}\AAEAO{S}+vor|\A§§") | (found == ""), F.lit(None).cast("string")).otherwise(found)


def section_range(label: Column) -> Column:
    """TX-19: the numbers that "vor §§ a bis b" or a list stands for; an array, empty if it stands for none."""
    rest = F.regexp_extract(label, rf"{I}(?s)vor{S}+§§?(.*)", 1)
    rest = F.get(F.split(rest, rf"{I}vor{S}+§§?"), F.lit(0))
    low, high = F.regexp_extract(rest, SECTION_SPAN, 1).try_cast("int"), F.regexp_extract(rest, SECTION_SPAN, 2).try_cast("int")
    whole = F.transform(F.sequence(low, F.greatest(low, F.least(high, low + 60))), lambda x: x.cast("string"))
    listed = F.slice(F.regexp_extract_all(rest, F.lit(r"(\d{1,4}[a-z]?)"), F.lit(1)), 1, 12)
    return F.when(~label.rlike(rf"{I}vor{S}+§§?"), F.array().cast("array<string>")).when((high >= low) & (high - low < 60), whole).otherwise(listed)


def marker_name(c: Column) -> Column:
    """TX-9: how an entry of a list is named in a path."""
    return F.when(c.rlike(r"\A\d+\z"), F.concat(F.lit("Nr. "), c)).when(c.rlike(r"\A[A-Za-z]\)?\z"), F.concat(F.lit("Buchst. "), sub(c, r"\)\z", ""))).otherwise(c)


def norm_id(c: Column) -> Column:
    """PRJ-1: the id of a norm from its label."""
    c = sub(_text(c), rf"\A§+{S}*", "")
    return F.lower(sub(trim(sub(c, rf"(?i)\AArt(?:ikel)?\.?{S}*", "art-")), rf"{S}+", "-"))


def absatz(path: Column) -> Column:
    """PRJ-2: the paragraph of a path, or an empty text."""
    return F.regexp_extract(_text(path), r"\A(Abs\. \d+[a-z]?)", 1)


def subject(title: Column) -> Column:
    """PRJ-3: what a statute is about, from its title."""
    return F.lower(trim(sub(_text(title), r"(?ius)gesetz.*\z", "")))


def short_key(c: Column) -> Column:
    """FLT-1: the form in which statutes are selected by name."""
    return sub(sub(F.lower(_text(c)), r"\.json\z", ""), "[^a-z0-9]", "")


def citation(*parts: Column) -> Column:
    """TX-29: the parts that are there, joined by a middle dot."""
    return F.concat_ws(" · ", *[F.nullif(p, F.lit("")) for p in parts])


def content_hash(texts: Column) -> Column:
    """TX-27: SHA-256 of the unit texts, joined by a space."""
    return F.sha2(F.array_join(texts, " "), 256)


def iso_date(c: Column) -> Column:
    """TX-30: YYYY-MM-DD of a timestamp text or of eight digits; null if there is none."""
    digits = F.regexp_extract(c, r"\A(\d{4})(\d{2})(\d{2})", 1)
    return F.when(digits != "", sub(F.substring(c, 1, 8), r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3")).when(c.rlike(r"\A\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10))


def fixed3(x: Column) -> Column:
    """TX-31: rounded to three decimals by the exact binary value, halves up, as toFixed(3) does.

    2000 * x - (2 n + 1) is computed without error from the two halves of x, so the sign is that of the exact value.
    """

    def rounded(x: Column) -> Column:
        n = F.floor(x * 1000)
        t = x * 134217729.0
        high = t - (t - x)
        low = x - high
        above = (high * 2000.0 - (n * 2 + 1)) + low * 2000.0
        return (n + F.when(above >= 0, 1).otherwise(0)) / F.lit(1000.0)

    return let(x, rounded)
