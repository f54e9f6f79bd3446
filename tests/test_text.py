"""Text functions on small values; the expected ones are worked out by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgrain.functions import text as T


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "function, given_, wanted",
    [
        (T.strip_markup, '<p><span class="sn">1</span>Der  Satz <em>gilt</em> .&nbsp;&amp;</p>', "Der Satz gilt. &"),
        (T.strip_markup, None, ""),
        (T.page_text, "a&#8364;b&#x2013;c&uuml;&quot;", 'a€b–cü"'),
        (T.page_text, "<b>x</b>­y", "x y"),
        (T.span_text, " , der  Satz , ist .; ", "der Satz, ist"),
        (T.clean_span, ",  soweit es gilt , wenn", "soweit es gilt"),
        (T.clean_span, None, ""),
        (T.phrase_key, "Nach § 3 Absatz 2 Satz 1 gilt 1.200 Euro.", "nach § gilt # euro"),
        (T.phrase_key, "allein", None),
        (lambda c: T.truncate(c, 14), "Eins zwei. Drei vier", "Eins zwei. […]"),
        (lambda c: T.truncate(c, 10), "kurz", "kurz"),
        (T.norm_id, "§ 15 a", "15-a"),
        (T.norm_id, "Art. 3", "art-3"),
        (T.absatz, "Abs. 2a Satz 1 Nr. 3", "Abs. 2a"),
        (T.absatz, "Satz 1", ""),
        (T.subject, "Solidaritätszuschlaggesetz 1995", "solidaritätszuschlag"),
        (T.section_number, "§ 15a EStG", "15a"),
        (T.section_number, "§§ 15 bis 16", None),
        (T.section_range, "Vor §§ 3 bis 6", ["3", "4", "5", "6"]),
        (T.section_range, "Vor § 12 und 14", ["12", "14"]),
        (T.section_range, "§ 5", []),
        (T.marker_name, "3", "Nr. 3"),
        (T.marker_name, "a)", "Buchst. a"),
        (T.marker_name, "aa", "aa"),
        (T.iso_date, "20240131", "2024-01-31"),
        (T.iso_date, "2024-01-31T00:00:00Z", "2024-01-31"),
        (T.iso_date, "", None),
        (T.time_only, "ab 2024", True),
        (T.time_only, "Die Regelung gilt erstmals ab 2024", False),
        (T.has_content, "ist", False),
        (T.has_content, "die Körperschaft", True),
        (T.escape_html, "a<b>&", "a&lt;b&gt;&amp;"),
    ],
)
def test_values(spark, function, given_, wanted):
    assert one(spark, function, given_) == wanted


def test_fixed3_goes_by_the_binary_value(spark):
    values = [0.5475, 0.0625, 0.1875, 1.0005, 0.0, 0.45, 0.9995]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", T.fixed3(F.col("x")).alias("y")).collect()
    from decimal import ROUND_HALF_UP, Decimal

    for r in rows:
        assert r["y"] == float(Decimal(r["x"]).quantize(Decimal("0.001"), ROUND_HALF_UP))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.;ü\n§1", max_size=20), min_size=1, max_size=5))
def test_normalising_twice_changes_nothing(spark, texts):
    once = T.span_text(F.col("x"))
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(once.alias("a"), T.span_text(once).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows if not r["a"].endswith(tuple(" ,;:.")))


def test_links_and_lines(spark):
    html = "<p>Eins</p><a href=\"/a?x=1\">A <b>b</b></a><a class='c' href='/b'>B</a><a href=c>C</a><br>zwei"
    df = spark.createDataFrame([(html,)], "x string")
    assert [tuple(x) for x in df.select(T.links(F.col("x")).alias("l")).first()["l"]] == [("/a?x=1", "A <b>b</b>"), ("/b", "B"), ("c", "C")]
    assert df.select(T.page_lines(F.col("x")).alias("l")).first()["l"] == ["Eins", "A b B C", "zwei"]


def test_junctor(spark):
    cases = [(["a und", "b"], "", "und"), (["a,", "oder b"], "", "oder"), (["a", "b"], "sämtliche", "und"), (["a", "b"], "", "oder"), (["a"], "", None)]
    for texts, intro, wanted in cases:
        assert spark.createDataFrame([(texts, intro)], "t array<string>, i string").select(T.junctor(F.col("t"), F.col("i")).alias("y")).first()["y"] == wanted
