"""Steps that were made cheaper give what the plain forms give, and are done once a row."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from lexgrain.functions import patterns as P
from lexgrain.functions import text as T
from lexgrain.functions import words as W
from lexgrain.operators import evaluation, merging, syntax
from lexgrain.operators import validation as V
from lexgrain.plans import annotation_queries, catalogue

SF = "/root/testdata/sf0.001"


def plain_key(c):
    c = T.sub(T.sub(F.lower(F.coalesce(c, F.lit(""))), T.SECTION_REFERENCE, "§"), T.NUMBER, "#")
    c = F.btrim(T.sub(T.sub(F.replace(c, F.lit("„"), F.lit(" ")), T.PHRASE_MARKS, " "), rf"{T.S}+", " "), F.lit(T.SPACES))
    n = F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))
    return F.when((n >= 2) & (n <= 8), c)


def plain_words(c):
    return F.regexp_count(c, F.lit(rf"{T.S}+")) + 1


def plain_class(t):
    t = F.coalesce(t, F.lit(""))
    bare = F.btrim(t, F.lit(T.SPACES))
    fragment = F.substring(t, 1, 12).rlike(rf"{T.B}(?:{'|'.join(W.MONTHS)}){T.B}") | t.rlike(rf"{T.B}dem \d{{1,2}}\.\z") | bare.rlike(rf"{T.B}\d\.\z")
    subject = bare.rlike(rf"(?iu)\A(?:Der|Die|Das){T.S}+[A-Za-z0-9_]+(?:zuschlag|steuer|abgabe)?\z")
    rest = F.when(plain_words(t) > 40, "zu grob (>40 Wörter)").when(t.rlike(r"BGBl\.|BStBl\."), "Fundstelle statt Merkmal").otherwise("nicht im Gold")
    return F.when(fragment, "fragment").when(subject, "nur Normsubjekt").otherwise(rest)


def plain_content(c):
    given = F.regexp_extract_all(F.lower(c), F.lit("([a-zäöüß]{4,})"), F.lit(1))
    return F.coalesce((F.length(c) >= 4) & ~F.lower(F.btrim(c, F.lit(T.SPACES))).isin(*W.FINITE) & F.exists(given, lambda w: ~w.isin(*W.FINITE, *W.FILLERS)), F.lit(False))


def plain_clean(c):
    c = T.sub(T.sub(F.coalesce(c, F.lit("")), rf"{T.S}+", " "), rf",{T.S}*,+", ",")
    c = T.sub(T.sub(F.btrim(T.sub(c, rf"{T.S}+([,.;])", "$1"), F.lit(T.SPACES)), rf"\A[,;:]{T.S}*", ""), r"[.,;:]\z", "")
    return F.btrim(T.sub(c, rf"(?iu)[,;]?{T.S}+(?:wenn|soweit|sofern|falls|und|oder|sowie|dass)\z", ""), F.lit(T.SPACES))


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    words = ["der", "Die", "DAS", "daſ", "Steuer", "§", "§ 3", "Abs. 2", "Absatz", "Januar", "dem", "7.", "12.", "3,5", "1.000", "„", "»", "(", "x;", "BGBl.", "İ", "größe", "à", "字", "wort", "#"]
    gaps = [" "] * 12 + ["  ", "\t", " ", " ", "\n", "﻿"]
    made = ["".join(r.choice(words) + r.choice(gaps if k % 2 else [" "]) for _ in range(r.choice([0, 1, 2, 3, 6, 8, 9, 30, 39, 40, 41, 42, 60]))) for k in range(3000)]
    made += [f(x) for x in made for f in (str.strip, lambda x: " " + x, lambda x: x.rstrip() + ".")]
    return spark.createDataFrame([(x,) for x in [None, "", " ", "　", "Der Mensch \n", " dem 7. "] + made], "t string")


@pytest.mark.parametrize(
    "new, plain",
    [
        (T.phrase_key, plain_key),
        (lambda c: evaluation.error_class(c, F.lit(None).cast("string")), plain_class),
        (lambda c: T.n_words(c), plain_words),
        (lambda c: T.more_words(c, 40), lambda c: plain_words(c) > 40),
        (T.trim, lambda c: F.btrim(c, F.lit(T.SPACES))),
        (T.squash, lambda c: T.sub(c, rf"{T.S}+", " ")),
        (T.has_content, plain_content),
        (T.clean_span, plain_clean),
    ],
)
def test_as_plain(odd, new, plain):
    rows = odd.select("t", new(F.col("t")).alias("a"), plain(F.col("t")).alias("b"))
    assert rows.where("not (a <=> b)").take(3) == []
    assert rows.select("b").distinct().count() > 1


@pytest.mark.parametrize("name", ["ag01_ag02_consistency", "ag01_phrase_counts", "snk05_consistency_totals", "tx12_phrase_keys"])
def test_a_phrase_has_its_key_made_once(spark, name):
    """Its filter isn't pushed down with a copy of the whole key, and no line is split at a pattern."""
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("buchst(?:abe") == 1 and "[.,;:!?]" not in plan


def test_a_span_has_its_quality_made_once(spark):
    """Rounding a confidence uses it nine times; the quality that it is made of is one of its parts."""
    plan = catalogue.queries()["mrg01_mrg06_merge"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(rf"{T.B}und{T.B}.*{T.B}oder{T.B}") == 1


def test_values_are_bound_without_copies(spark):
    """A value bound as the element of a transformed array has its result copied, and typed anew, for each row."""
    plan = catalogue.queries()["mrg01_mrg06_merge"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(" not in plan and plan.count("aggregate([]") > 50


CUES = ["wenn", "WENN", "ſoweit", "daſs", "İst", "ıst", "IST", "STEHT", "Kann", "kann", "ERMÄẞIGT", "ermäßigt", "MÜSSEN", "dürfen", "es sei denn", "mit Ausnahme", "Gilt nicht", "außer in", "AUẞER wenn", "sinngemäß", "gilt entsprechend", "gilt als",
        "wird x behandelt", "gleich", "gleichgestellt.", "steht dem Wort y gleich", "auf volle", "vom Hundert", "v. H.", "Steuersatz", "im Sinne dieses Gesetzes", "Begriff", "Bei", "NACH", "Abweichend von", "steuerfrei", "ZULÄSSIG", "Dies", "Satz 1", "der Mensch",
        "Die Größe für Ämter", "zu zahlen", "GEZAHLT", "angeſetzt", "unberührt", "außer Ansatz", "hinzuzurechnen", "in der Fassung des x anzuwenden", "erstmals im Veranlagungszeitraum", "(1,5)", "Σας", "Å", "x", "ä", "字", "\U0001d400"]


def test_folded_texts_have_the_matches_of_patterns_that_ignore_case(spark):
    r = random.Random(7)
    made = ["".join(r.choice(CUES) + r.choice([" ", " ", " ", ", ", "; ", "", "_", "\xa0", ".", "İ", "K"]) for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13]))) for _ in range(6000)]
    df = spark.createDataFrame([(x,) for x in CUES + made], "t string")
    low = T.folded(F.col("t"))
    names = ("SUBJUNCTION", "FINITE_VERB", "PREDICATIVE", "CONDITIONAL_FRONT", "PRONOUN", "EXCEPTION", "REFERENCE", "APPLICATION", "FICTION", "DEFINITION_STRONG", "EQUATION", "CALCULATION", "TARIFF", "BRACKET_OPEN")
    patterns = {**{n: getattr(P, n) for n in names}, "HIDDEN_CLAUSE": syntax.HIDDEN_CLAUSE}
    place = lambda c, p: F.regexp_instr(c, F.lit(p))
    span = lambda c, p: F.struct(place(c, p).alias("at"), F.length(F.regexp_substr(c, F.lit(p))).alias("n"))
    wrong = [F.count_if(span(F.col("t"), p) != span(low, P.small(p))).alias(n) for n, p in patterns.items()]
    seen = [F.count_if(place(F.col("t"), p) > 0).alias(f"seen_{n}") for n, p in patterns.items()]
    got = df.agg(*wrong, *seen).first().asDict()
    assert {n: got[n] for n in patterns if got[n]} == {} and min(got[f"seen_{n}"] for n in patterns) > 5


def test_rounded_as_before(spark):
    r = random.Random(5)
    numbers = [r.random() for _ in range(2000)] + [k / 2000 for k in range(2001)]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", T.fixed3(F.col("x")).alias("y")).collect()
    assert all(y == float(Decimal(x).quantize(Decimal("0.001"), ROUND_HALF_UP)) for x, y in got)


def test_the_report_only_makes_what_it_counts(spark):
    """No place, confidence, address or anchor of a span goes into the report, and no whole text of a norm is searched for it."""
    plan = catalogue.queries()["snk05_run_report"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in ("starts(", "sha2(", "Abs. ", "konfidenz", "gegenprobe", rf"{T.B}und{T.B}.*{T.B}oder{T.B}") if x in plan]


def test_outcomes_are_those_of_the_merge(spark):
    whole = annotation_queries.merged(spark, SF).select("norm_id", "seq", (F.size("spannen") > 0).alias("steht"), F.size("abgelehnt").alias("abgelehnt"), "text", "typ", "verberst", "elemente")
    u = F.struct("text", "typ", "verberst", "elemente")
    got = whole.select("*", merging.outcome(u, F.lit("einkommensteuer")).alias("o")).cache()
    assert got.where("not (o.steht <=> steht) or not (o.abgelehnt <=> abgelehnt)").take(3) == []
    assert got.where("steht").count() > 300 and got.where("abgelehnt > 0").count() > 100


def plain_subject(t):
    core = T.sub(T.sub(F.lower(t), rf"\A(?:der|die|das|dieser|diese|dieses|ein|eine|einer){T.S}+", ""), r"[.,;:]\z", "")
    return (plain_words(core) <= 4) & (F.startswith(core, F.lit("steuer")) | F.startswith(F.lit("steuer"), core) | F.btrim(t, F.lit(T.SPACES)).rlike(V.BARE_SUBJECT))


def plain_reason(t):
    t = F.btrim(F.coalesce(t, F.lit("")), F.lit(T.SPACES))
    end = F.right(t, F.lit(24))
    return (
        F.when(F.length(t) < 4, "zu kurz").when(F.length(t) > 600, "zu lang (>600 Zeichen)")
        .when(t.rlike(V.MONTH_START), "Fragment: beginnt mit Monatsnamen").when(t.rlike(r"\A[,;:.)\]]"), "Fragment: beginnt mit Satzzeichen")
        .when(end.rlike(V.CUT_ORDINAL), "Fragment: endet auf abgeschnittener Ordinalzahl").when(end.rlike(V.CUT_END), "Fragment: endet auf Artikel oder Präposition")
        .when(t.rlike(V.LOOSE_START), "Fragment: beginnt mit Konjunktion oder finitem Verb").when((plain_words(t) < 12) & t.rlike(V.GAZETTE), "Fundstelle statt Merkmal")
        .when(T.time_only(t), "reine Zeitangabe").when(t.rlike(V.REFERENCE_ONLY), "reiner Paragrafenverweis ohne Merkmalsgehalt")
        .when(plain_words(t) > 45, F.concat(F.lit("zu grob ("), plain_words(t).cast("string"), F.lit(" Wörter)")))
        .when((plain_words(t) <= 5) & plain_subject(t), "bloßes Normsubjekt")
    )


def test_vetoes_as_plain(spark):
    r = random.Random(11)
    words = ["der", "Die", "DAS", "daſ", "dem", "für", "FÜR", "ım", "İm", "nach", "NACH", "und", "ſowie", "Sind", "ıst", "İst", "bzw.", "wird", "Steuer", "steuerlich", "Januar", "März", "7.", "12.", "§ 3", "§ 3 Abs. 2", "Artikel 4", "BGBl.", "BStBl.", "x", ",", ";", ")", "Größe", "Wortlaut", "字", "eine"]
    made = [" ".join(r.choice(words) for _ in range(r.choice([1, 1, 2, 2, 3, 4, 5, 6, 12, 46]))) + r.choice(["", "", ".", ";"]) for _ in range(6000)]
    rows = spark.createDataFrame([(x,) for x in made], "t string")
    long = F.concat(F.lit("y" * 800), "t")
    new = V.reject_reason(F.lit("tb"), F.col("t"), long, F.lit("z"), F.lit("aussage"), F.lit("steuer"), F.lit(False))
    rows = rows.select("t", new.alias("a"), plain_reason(F.col("t")).alias("b")).cache()
    assert rows.where("not (a <=> b)").take(3) == [] and rows.select("b").distinct().count() > 9
    elsewhere = [V.reject_reason(F.lit("tb"), F.lit("ein Wortlaut"), F.lit("anderer Satz"), F.lit(x).cast("string"), F.lit("aussage"), F.lit(""), F.lit(False)) for x in ("hier ein Wortlaut", "hier nicht", None)]
    assert list(spark.range(1).select(*elsewhere).first()) == ["steht in einem anderen Rechtssatz als angegeben", "nicht wörtlich im Normtext", "steht in einem anderen Rechtssatz als angegeben"]


def test_conditions_are_found_behind_their_cues(spark):
    r = random.Random(13)
    words = ["wenn", "WENN", "ſoweit", "Sofern", "falls", "FALLſ", "ſolange nicht", "Wort", "ist", "wird,", "kann", "x;", "größer", "\xa0"]
    made = [r.choice(["", "", ", "]) + "".join(r.choice(words) + r.choice([" ", " ", ", ", "; ", ",\xa0"]) for _ in range(r.choice([1, 3, 6, 10]))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in made], "t string").select("t", T.let(F.col("t"), lambda t: syntax.condition_span(t, F.lit(-1))).alias("a"), (syntax.place(F.col("t"), P.CONDITION) >= 0).alias("b"))
    found = syntax.any_of(T.folded(F.col("t")), *P.CUES[P.CONDITION])
    assert df.where(F.col("b") & ~found).take(3) == [] and df.where(F.col("a").isNotNull() & ~F.col("b")).take(3) == [] and df.where("b").count() > 500 and df.where("not b").count() > 50
