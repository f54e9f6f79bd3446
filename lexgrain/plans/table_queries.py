"""Consistency, voting, validation, evaluation, windows, joins and set operators over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import MONTHS, TYPE_MATCHES
from ..operators import audit, consistency, evaluation, evidence, merging, relational, validation
from ..sources import sinks
from ..sources.staging import new_path
from ..streaming import incremental
from .registry import LINES, S, query, span_text, squash, table, trim
from .text_queries import TIME, lines

_KIND = "CASE lang WHEN 'en' THEN 'tb' WHEN 'de' THEN 'rf' WHEN 'fr' THEN 'ausn' ELSE 'def' END"
_CLAUSES = f"SELECT doc_id, lang, (doc_id, seq, generate_subscripts(c, 1)) AS stelle, unnest(c) AS text FROM (SELECT doc_id, lang, seq, string_split_regex(line, '[.,;:!?]') AS c FROM ({LINES}))"
_SPANS = f"SELECT doc_id, stelle, {_KIND} AS art, text, (length(text) % 100) / 100.0 AS konfidenz FROM ({_CLAUSES}) WHERE regexp_matches(text, '[A-Za-z]')"
_KEYED = f"SELECT * FROM (SELECT *, {trim(squash('''regexp_replace(regexp_replace(lower(text), '\\b\\d[\\d.,]*\\b', '#', 'g'), '[„\"»«(),;:.]', ' ', 'g')'''))} AS schluessel FROM ({_SPANS})) WHERE len(string_split(schluessel, ' ')) BETWEEN 2 AND 8"
_COUNTS = f"""SELECT schluessel, count(*) FILTER (art = 'tb') AS tb, count(*) FILTER (art = 'rf') AS rf, count(*) FILTER (art = 'ausn') AS ausn, min_by(text, stelle) AS wendung FROM ({_KEYED}) GROUP BY schluessel"""
_FOUND = f"""SELECT *, tb + rf + ausn AS gesamt, CASE WHEN tb = greatest(tb, rf, ausn) THEN 'tb' WHEN rf = greatest(tb, rf, ausn) THEN 'rf' ELSE 'ausn' END AS mehrheit FROM ({_COUNTS})
  WHERE tb + rf + ausn >= 4 AND greatest(tb, rf, ausn) < tb + rf + ausn AND greatest(tb, rf, ausn) / (tb + rf + ausn) >= 0.8"""


def spans(spark, sf_dir):
    """The clauses of all lines, between punctuation marks, labelled by the language of the document."""
    kind = F.when(F.col("lang") == "en", "tb").when(F.col("lang") == "de", "rf").when(F.col("lang") == "fr", "ausn").otherwise("def")
    cut = reduce(lambda c, mark: F.replace(c, F.lit(mark), F.lit(",")), ".;:!?", F.col("line"))  # a split at a class compiles its pattern for each line
    clauses = lines(spark, sf_dir).select("doc_id", "lang", F.col("seq").cast("long").alias("zeile"), F.posexplode(F.split(cut, ",", -1)).alias("k", "text")).where(F.col("text").rlike("[A-Za-z]"))
    return clauses.select("doc_id", F.struct("doc_id", "zeile", "k").alias("seq"), kind.alias("art"), "text", ((F.length("text") % 100) / F.lit(100.0)).alias("konfidenz"))


@query(f"SELECT schluessel, wendung, tb, rf, ausn, gesamt, mehrheit, count(*) AS ausreisser, min(konfidenz) AS min_konfidenz FROM ({_FOUND}) f JOIN ({_KEYED}) k USING (schluessel) WHERE art <> mehrheit GROUP BY ALL")
def ag01_ag02_consistency(spark, sf_dir):
    """Phrases that are labelled inconsistently: the flagship."""
    return consistency.report(spans(spark, sf_dir))


@query(f"SELECT schluessel, tb, rf, ausn, wendung FROM ({_COUNTS})")
def ag01_phrase_counts(spark, sf_dir):
    return consistency.phrase_counts(consistency.with_keys(spans(spark, sf_dir)))


@query(f"SELECT count(*) AS wendungen, (SELECT count(*) FROM ({_FOUND}) f JOIN ({_KEYED}) k USING (schluessel) WHERE art <> mehrheit) AS verdaechtig, 4 AS min, 0.8::DOUBLE AS quote FROM ({_COUNTS})")
def snk05_consistency_totals(spark, sf_dir):
    counts = consistency.phrase_table(consistency.with_keys(spans(spark, sf_dir)))
    odd = F.sum(F.when(consistency.is_finding(), consistency.n_outliers()))
    return counts.agg(F.count("*").alias("wendungen"), F.coalesce(odd, F.lit(0)).alias("verdaechtig"), F.lit(4).alias("min"), F.lit(0.8).alias("quote"))


# Windows -------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS frage FROM conversations")
def wn01_forward_fill(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").withColumn("frage", F.when(F.col("role") == "user", F.md5(F.col("text").cast("binary"))))
    return relational.forward_fill(asked, "frage", ["conv_id"], ["turn"]).select("conv_id", "turn", "frage")


@query("SELECT conv_id, sitzung::BIGINT AS sitzung, string_agg(md5(text), ' ' ORDER BY turn) AS texte, count(*) AS n FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS sitzung FROM conversations) GROUP BY conv_id, sitzung")
def wn02_sessions(spark, sf_dir):
    dealt = relational.sessions(table(spark, sf_dir, "conversations"), F.col("role") == "user", ["conv_id"], ["turn"])
    pairs = F.array_sort(F.collect_list(F.struct("turn", F.md5(F.col("text").cast("binary")).alias("h"))))
    return dealt.groupBy("conv_id", "sitzung").agg(F.array_join(F.transform(pairs, lambda x: x["h"]), " ").alias("texte"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag || CASE WHEN n > 1 THEN ' (Teil ' || n || ')' ELSE '' END AS pfad FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2))")
def wn03_duplicate_ordinals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    n = relational.ordinals(rows, ["l_orderkey", "l_returnflag"], ["l_linenumber"])
    return n.select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.when(F.col("n") > 1, F.concat(F.lit(" (Teil "), "n", F.lit(")"))).otherwise("")).alias("pfad"))


@query(
    f"""SELECT doc_id, seq, von::BIGINT AS von, (von + length(line))::BIGINT AS bis FROM (
      SELECT doc_id, seq, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY seq) - length(line) - 1 AS von FROM (
        SELECT doc_id, seq - 1 AS seq, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM documents)))"""
)
def wn04_anchors(spark, sf_dir):
    """Every line of a document, sought from the end of the one before."""
    from ..operators.segmentation import anchors

    parts = F.split("text", "\n", -1)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(parts, lambda x: F.concat(x, F.lit("\n"))).alias("zeilen"), F.concat("text", F.lit("\n")).alias("ganz"))
    placed = rows.withColumn("orte", anchors(F.col("zeilen"), F.col("ganz")))
    return placed.select("doc_id", F.posexplode("orte").alias("seq", "o")).select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("o.von").cast("long").alias("von"), (F.col("o.bis") - 1).cast("long").alias("bis"))


@query(
    """SELECT page_id, seq, start::BIGINT AS start, (coalesce(lead(start) OVER (PARTITION BY page_id ORDER BY start), n) - start)::BIGINT AS laenge FROM (
      SELECT page_id, seq, n, sum(length(piece) + CASE WHEN seq > 0 THEN 3 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY seq) - length(piece) - 2 AS start FROM (
        SELECT page_id, length(html) AS n, generate_subscripts(p, 1) - 1 AS seq, unnest(p) AS piece FROM (SELECT page_id, html, string_split(html, '<p>') AS p FROM pages))) WHERE seq > 0"""
)
def wn05_section_extents(spark, sf_dir):
    """Each paragraph mark of a page reaches to the next one."""
    pieces = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("n"), F.posexplode(F.split("html", "<p>", -1)).alias("seq", "p"))
    before = F.sum(F.length("p") + 3).over(Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = pieces.select("page_id", "n", "seq", (before - 2).alias("start")).where("seq > 0")
    return relational.extents(rows, "start", "n", ["page_id"]).select("page_id", F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), (F.col("ende") - F.col("start")).cast("long").alias("laenge"))


@query("SELECT source, doc_id, rang FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rang FROM documents) WHERE rang <= 5")
def wn06_snk04_top_of_each(spark, sf_dir):
    return relational.ordinals(table(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), "doc_id"], "rang").where("rang <= 5").select("source", "doc_id", "rang")


@query("SELECT event_id, lag(event_type) OVER w AS vorige, lead(event_type) OVER w AS naechste FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def wn07_neighbours(spark, sf_dir):
    return relational.neighbours(table(spark, sf_dir, "events"), "event_type", ["user_id"], ["ts", "event_id"]).select("event_id", "vorige", "naechste")


# Joins and set operators ---------------------------------------------------------------------------------------


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NULL AS fehlt FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn01_left_outer(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("da", F.lit(True))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("da").isNull().alias("fehlt"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def jn02_jn03_missing(spark, sf_dir):
    side = lambda name: table(spark, sf_dir, name).select("doc_id", F.lit("x").alias("text_hash"))
    return incremental.changed(side("documents"), side("labels"), ("doc_id",)).select("doc_id")


@query("SELECT n_name, r_name, count(*) AS kunden, round(sum(c_acctbal), 2) AS saldo FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def jn04_dimension_join(spark, sf_dir):
    dims = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("s"))
    return rows.join(dims, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.sum("n").alias("kunden"), F.sum("s").cast("double").alias("saldo"))


@query("SELECT p_partkey, coalesce(a.preis, b.preis) AS preis, CASE WHEN a.preis IS NOT NULL THEN 'rueckgabe' ELSE 'verkauf' END AS quelle FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS preis FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.l_partkey = p_partkey LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS preis FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) b ON b.l_partkey = p_partkey WHERE coalesce(a.preis, b.preis) IS NOT NULL")
def jn05_jn06_priority(spark, sf_dir):
    """The returned price of a part if there is one, else that of its sales."""
    items = table(spark, sf_dir, "lineitem")
    side = lambda test, name: items.where(test).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("preis")).withColumn("quelle", F.lit(name))
    return relational.prefer([side("l_returnflag = 'R'", "rueckgabe"), side("l_returnflag <> 'R'", "verkauf")], ["p_partkey"]).join(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


@query(
    """WITH c AS (SELECT o_orderkey AS claim_id, o_custkey AS k, 'Order ' || o_orderpriority AS f FROM orders), e AS (SELECT o_custkey AS k, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'Order ' || o_orderpriority || ' ' || o_orderstatus ELSE 'x' || o_orderkey END AS b FROM orders)
    SELECT claim_id, beleg_seq FROM (SELECT claim_id, e.seq AS beleg_seq, row_number() OVER (PARTITION BY claim_id ORDER BY e.seq) AS n FROM c JOIN e USING (k) WHERE contains(lower(b), lower(f)) OR contains(lower(f), lower(b))) WHERE n = 1"""
)
def jn07_citation_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("x").alias("abk"), F.col("o_custkey").cast("string").alias("norm_id"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    claims = o.select("abk", "norm_id", F.col("o_orderkey").alias("claim_id"), F.concat(F.lit("Order "), "o_orderpriority").alias("fundstelle"))
    label = F.expr("CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'Order ' || o_orderpriority || ' ' || o_orderstatus ELSE 'x' || o_orderkey END")
    pieces = o.select("abk", "norm_id", F.col("o_orderkey").alias("seq"), F.lit("verwaltung").alias("art"), label.alias("kennung"), F.lit("").alias("az"))
    return evidence.match_citations(claims, pieces).select("claim_id", "beleg_seq")


@query("SELECT c_custkey, 'neu' AS stand, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1 UNION ALL SELECT c_custkey, 'alt', 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def jn12_carry_over(spark, sf_dir):
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).select("c_custkey", F.lit("neu").alias("stand"), "n")
    old = table(spark, sf_dir, "customer").select("c_custkey", F.lit("alt").alias("stand"), F.lit(0).cast("long").alias("n"))
    return relational.carry_over(new, old, ["c_custkey"]).join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query("SELECT owner, art, quelle, fundstelle, url, seq FROM (SELECT *, row_number() OVER (PARTITION BY owner, art, quelle, fundstelle, url ORDER BY alt, seq) AS n FROM (SELECT o_custkey AS owner, 'verwaltung' AS art, o_orderpriority AS quelle, o_orderstatus AS fundstelle, '' AS url, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS alt FROM orders)) WHERE n = 1")
def set01_union_distinct(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.lit("verwaltung").alias("art"), F.col("o_orderpriority").alias("quelle"), F.col("o_orderstatus").alias("fundstelle"), F.lit("").alias("url"), F.col("o_orderkey").alias("seq"))
    return evidence.union_distinct(o.where("seq % 2 = 0"), o.where("seq % 2 <> 0"), ["owner"])


@query("SELECT lang, source, max_by(doc_id, (length(text), -doc_id)) AS doc_id, max(length(text)) AS n FROM documents GROUP BY 1, 2")
def set02_keep_longest(spark, sf_dir):
    best = relational.longest_by_key(table(spark, sf_dir, "documents"), ["lang", "source"], "text", "doc_id")
    return best.select("lang", "source", "doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT lower(o_orderpriority) AS wendung, min(o_orderkey) AS seq, min_by(o_orderpriority, o_orderkey) AS beispiel FROM orders GROUP BY 1")
def set04_ag11_distinct_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("wendung", F.lower("o_orderpriority"))
    return relational.first_by_key(rows, ["wendung"], ["o_orderkey", "o_orderpriority"], "o_orderkey").select("wendung", F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("beispiel"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def jn09_containment(spark, sf_dir):
    """Benchmark texts that stand in a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return relational.containment(docs, table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


# Aggregations --------------------------------------------------------------------------------------------------

_VOTES = "SELECT user_id, event_type AS typ, min(event_id) AS erst, count(*) AS n FROM events GROUP BY 1, 2"


@query(f"SELECT user_id, max_by(typ, (n, -erst)) AS typ FROM ({_VOTES}) GROUP BY 1")
def ag03_type_vote(spark, sf_dir):
    """The most frequent type of each user; the first seen wins ties."""
    return merging.vote(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id").select("user_id", F.col("event_type").alias("typ"))


def _fixed3(x: str) -> str:
    """Three decimals by the exact binary value, halves up: the sign of 2000 x - (2 n + 1) is computed without error."""
    high = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    return f"(floor({x} * 1000) + CASE WHEN ({high} * 2000 - (floor({x} * 1000) * 2 + 1)) + ({x} - {high}) * 2000 >= 0 THEN 1 ELSE 0 END) / 1000.0"


@query(
    f"""SELECT user_id, n_spannen, {_fixed3('m')} AS konfidenz, {_fixed3('e')} AS einstimmigkeit, {_fixed3('b')} AS belegquote, CASE WHEN b >= 0.4 AND m >= 0.7 THEN 'belegt' WHEN m >= 0.75 AND e >= 0.7 THEN 'konsens' WHEN m >= 0.5 THEN 'mehrheit' ELSE 'uneinheitlich' END AS status
    FROM (SELECT user_id, count(*) AS n_spannen, avg((event_id % 8) / 8.0 + 0.125) AS m, avg((event_id % 3 = 0)::INT) AS e, avg((event_type = 'purchase')::INT) AS b FROM events GROUP BY 1)"""
)
def ag04_status_ladder(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", ((F.col("event_id") % 8) / 8.0 + 0.125).alias("konfidenz"), F.when(F.col("event_id") % 3 == 0, 3).otherwise(1).alias("stimmen"), F.when(F.col("event_type") == "purchase", "b").alias("beleg"))
    b = merging.balance(e, 3, ("user_id",))
    return b.select("user_id", "n_spannen", "konfidenz", "einstimmigkeit", "belegquote", "status")


_RULE = "length(text) - length(regexp_replace(text, '[#*%&|]', '', 'g')) > 0.05 * length(text)"


@query(
    f"""WITH c AS (SELECT sum((p AND g)::INT) AS tp, sum((p AND NOT g)::INT) AS fp, sum((g AND NOT p)::INT) AS fn FROM (SELECT {_RULE} AS p, quality = 0 AS g FROM documents JOIN labels USING (doc_id)))
    SELECT 'quality' AS art, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)"""
)
def ag05_precision_recall(spark, sf_dir):
    """A symbol rule against the quality labels."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") - F.length(F.regexp_replace("text", "[#*%&|]", "")) > F.length("text") * 0.05).alias("p")).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("g", F.col("quality") == 0)
    counts = rows.agg(F.count_if(F.col("p") & F.col("g")).alias("tp"), F.count_if(F.col("p") & ~F.col("g")).alias("fp"), F.count_if(~F.col("p") & F.col("g")).alias("fn")).withColumn("art", F.lit("quality"))
    return evaluation.precision_recall(counts).select("art", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_MAP = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(t) for t in v)}]" for k, v in TYPE_MATCHES.items()) + "}"


@query(f"SELECT gold, round(avg((coalesce(list_contains({_MAP}[gold], ist), FALSE))::INT), 6) AS quote, count(*) AS n FROM (SELECT ['konditional', 'tarif', 'verweisung', 'definition', 'kollision', 'sonstig'][1 + event_id % 6] AS gold, ['rule', 'konditional', 'tarif', 'verweisung', 'definition', 'gemischt', 'calculation'][1 + event_id % 7] AS ist FROM events) GROUP BY 1")
def ag06_type_accuracy(spark, sf_dir):
    pick = lambda names, n: F.element_at(F.lit(names), (F.col("event_id") % n + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(pick(["konditional", "tarif", "verweisung", "definition", "kollision", "sonstig"], 6).alias("gold"), pick(["rule", "konditional", "tarif", "verweisung", "definition", "gemischt", "calculation"], 7).alias("ist"))
    return rows.groupBy("gold").agg(F.round(F.avg(evaluation.type_matches(F.col("gold"), F.col("ist")).cast("int")), 6).alias("quote"), F.count("*").alias("n"))


@query(
    f"""SELECT klasse, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(trim(line), '\\b\\d\\.\\z') THEN 'fragment' WHEN regexp_matches({trim('line')}, '(?i)\\A(?:Der|Die|Das){S}+\\w+(?:zuschlag|steuer|abgabe)?\\z') THEN 'nur Normsubjekt'
      WHEN len(regexp_split_to_array(line, '{S}+')) > 40 THEN 'zu grob (>40 Wörter)' ELSE 'nicht im Gold' END AS klasse FROM ({LINES})) GROUP BY 1"""
)
def ag07_ag08_ev02_error_classes(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("klasse", evaluation.error_class(F.col("line"), F.lit(None).cast("string")))
    return evaluation.histogram(rows, "klasse")


@query("SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS zeichen FROM documents GROUP BY ROLLUP (source, lang)")
def ag09_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("zeichen"))


@query("SELECT 'nationen' AS name, 25 AS erwartet, (SELECT count(*) FROM nation) AS gezaehlt, (SELECT count(*) FROM nation) = 25 AS gilt UNION ALL SELECT 'regionen', 5, (SELECT count(*) FROM region), (SELECT count(*) FROM region) = 5")
def ag10_invariants(spark, sf_dir):
    n = table(spark, sf_dir, "nation").agg(F.count("*").alias("nationen"), F.lit(None).cast("long").alias("regionen"))
    r = table(spark, sf_dir, "region").agg(F.lit(None).cast("long").alias("nationen"), F.count("*").alias("regionen"))
    return audit.invariants(n.unionByName(r).agg(F.max("nationen").alias("nationen"), F.max("regionen").alias("regionen")), {"nationen": 25, "regionen": 5})


@query("SELECT source, doc_id // 1000 AS teil, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS stellen, count(*) AS n FROM documents GROUP BY 1, 2")
def ag14_bundles(spark, sf_dir):
    """The ids of each source, in bundles of an id range."""
    return relational.bundles(table(spark, sf_dir, "documents"), ["source"], "doc_id", 1000).select("source", "teil", F.array_join(F.transform("eintraege", lambda x: x.cast("string")), ",").alias("stellen"), "n")


# Validation, order, budgets ------------------------------------------------------------------------------------

_EDGE, _END = "(?:\\A|[^A-Za-z0-9_])", "(?:\\z|[^A-Za-z0-9_])"
_VETOES = f"""
      WHEN length(t) < 4 THEN 'zu kurz' WHEN length(t) > 600 THEN 'zu lang (>600 Zeichen)'
      WHEN NOT contains(satz, t) AND NOT contains(norm, t) THEN 'nicht wörtlich im Normtext' WHEN NOT contains(satz, t) THEN 'steht in einem anderen Rechtssatz als angegeben'
      WHEN typ = 'anwendung' THEN 'Normtyp „' || typ || '" wird nicht markiert'
      WHEN regexp_matches(t, '\\A(?:{'|'.join(MONTHS)}){_END}') THEN 'Fragment: beginnt mit Monatsnamen' WHEN regexp_matches(t, '\\A[,;:.)\\]]') THEN 'Fragment: beginnt mit Satzzeichen'
      WHEN regexp_matches(right(t, 24), '{_EDGE}\\d{{1,2}}\\.{S}*\\z') THEN 'Fragment: endet auf abgeschnittener Ordinalzahl'
      WHEN regexp_matches(right(t, 24), '(?i){_EDGE}(?:{'|'.join(validation.CUT_WORDS)}){S}*\\z') THEN 'Fragment: endet auf Artikel oder Präposition'
      WHEN art = 'tb' AND regexp_matches(t, '(?i)\\A(?:(?:und|oder|sowie|aber|denn|sondern|beziehungsweise|wird|werden|ist|sind|so){_END}|bzw\\.[A-Za-z0-9_])') THEN 'Fragment: beginnt mit Konjunktion oder finitem Verb'
      WHEN n < 12 AND regexp_matches(t, '{_EDGE}(?:BGBl\\.|BStBl\\.|BAnz\\.)') THEN 'Fundstelle statt Merkmal'
      WHEN regexp_matches(t, '{TIME}') AND length(regexp_replace(regexp_replace(t, '{TIME}', ''), '[^A-Za-z0-9_äöüßÄÖÜ]', '', 'g')) < 12 THEN 'reine Zeitangabe'
      WHEN regexp_matches(t, '{validation.REFERENCE_ONLY.replace(T.S, S)}') THEN 'reiner Paragrafenverweis ohne Merkmalsgehalt'
      WHEN n > CASE WHEN art = 'rf' THEN 75 ELSE 45 END THEN 'zu grob (' || n || ' Wörter)'
      WHEN art = 'tb' AND length(t) > length(satz) * 0.85 AND n > 20 THEN 'deckt praktisch den ganzen Rechtssatz ab'
      WHEN art = 'tb' AND len(regexp_split_to_array(kern, '{S}+')) <= 4 AND (starts_with(kern, 'kein gegenstand') OR starts_with('kein gegenstand', kern) OR regexp_matches(t, '\\A(?:der|die|das)[\\s\\x0B\\x{{A0}}]+[A-ZÄÖÜ][A-Za-z0-9_äöüß-]+\\z')) THEN 'bloßes Normsubjekt'
      WHEN art = 'def' AND n > 8 THEN 'Definiendum zu lang'
      WHEN typ = 'tarif' AND art = 'tb' AND NOT regexp_matches(t, '(?i)\\A(?:bei|beim|in den Fällen|für|soweit|auf)') THEN 'Tarifnorm ohne konditionales Vorfeld — kein Tatbestandsmerkmal'
      WHEN typ = 'rechenregel' AND art <> 'rf' THEN 'Rechenregel ist vollständig Rechtsfolge' WHEN art = 'def' AND typ <> 'definition' THEN 'Definiendum nur in Definitionen'"""
_PIECES = f"""SELECT doc_id, seq, t, ['tb', 'rf', 'def'][1 + seq % 3] AS art, ['konditional', 'tarif', 'rechenregel', 'definition', 'anwendung'][1 + doc_id % 5] AS typ,
      CASE WHEN seq % 7 = 6 THEN 'anders' ELSE t END AS satz, CASE WHEN seq % 14 = 13 THEN 'anders' ELSE t END AS norm
    FROM (SELECT doc_id, seq, {trim("CASE WHEN seq % 4 = 3 THEN array_to_string(list_slice(string_split(line, ' '), 1, 3), ' ') WHEN seq % 20 = 18 THEN ['Januar und weiter', 'ab 2024', '§ 3 Abs. 2', 'siehe BGBl. I', 'die Steuer'][1 + doc_id % 5] ELSE line END")} AS t FROM ({LINES}))"""


@query(
    f"""SELECT doc_id, seq, CASE {_VETOES} END AS grund FROM (
      SELECT *, len(regexp_split_to_array(t, '{S}+')) AS n, regexp_replace(regexp_replace(lower(t), '\\A(?:der|die|das|dieser|diese|dieses|ein|eine|einer){S}+', ''), '[.,;:]\\z', '') AS kern FROM ({_PIECES}))"""
)
def val01_span_vetoes(spark, sf_dir):
    """Each line, or its first words, as a span of each kind in sentences of several types; some aren't in their sentence or norm."""
    c, seq = F.col, F.col("seq").cast("int")
    pick = lambda names, n: F.get(F.lit(names), (n % len(names)).cast("int"))
    own = pick(["Januar und weiter", "ab 2024", "§ 3 Abs. 2", "siehe BGBl. I", "die Steuer"], c("doc_id"))
    text = F.when(seq % 4 == 3, F.array_join(F.slice(F.split("line", " "), 1, 3), " ")).when(seq % 20 == 18, own).otherwise(c("line"))
    rows = lines(spark, sf_dir).select("doc_id", c("seq").cast("long").alias("seq"), T.trim(text).alias("text"), pick(["tb", "rf", "def"], seq).alias("art"), pick(["konditional", "tarif", "rechenregel", "definition", "anwendung"], c("doc_id")).alias("typ"))
    rows = rows.withColumns({"satztext": F.when(c("seq") % 7 == 6, "anders").otherwise(c("text")), "volltext": F.when(c("seq") % 14 == 13, "anders").otherwise(c("text")), "gegenstand": F.lit("kein gegenstand"), "verberst": F.lit(False)})
    return validation.validate(rows).select("doc_id", "seq", "grund")


@query("SELECT event_id, CASE WHEN event_type <> v THEN 'Kategorie uneinheitlich: ' || event_type || ' vs. ' || v END AS widerspruch FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events)")
def val03_conflicts(spark, sf_dir):
    """What is said of a user's event against what was said of the one before."""
    rows = relational.neighbours(table(spark, sf_dir, "events"), "event_type", ["user_id"], ["event_id"])
    return rows.select("event_id", validation.conflict(F.col("event_type"), F.col("vorige")).alias("widerspruch"))


@query("SELECT abk, seq, text, grund FROM (SELECT o_orderpriority AS abk, o_orderkey AS seq, substr(repeat(o_orderpriority || ' ', 12), 1, 90) AS text, 'zu kurz' AS grund, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n <= 25")
def snk04_rejections(spark, sf_dir):
    """The first rejected spans of each statute, their texts cut."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("abk"), F.col("o_orderkey").alias("seq"), F.repeat(F.concat("o_orderpriority", F.lit(" ")), F.lit(12)).alias("text"), F.when(F.col("o_orderstatus") == "F", "zu kurz").alias("grund"))
    return validation.rejections(o, 25).select("abk", "seq", "text", "grund")


@query("SELECT lang AS abk, sum(n)::BIGINT AS normen, sum(m)::BIGINT AS markierbar, sum(a)::BIGINT AS abgelehnt FROM (SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 500) AS m, (SELECT count(*) FROM labels l JOIN documents e USING (doc_id) WHERE e.lang = d.lang AND quality = 0) AS a FROM documents d GROUP BY lang) GROUP BY ROLLUP (lang)")
def snk05_ag09_report(spark, sf_dir):
    """The run report of all statutes: norms, markable norms, rejected spans, and their sums."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("abk"), (F.col("n_chars") > 500).alias("markierbar"))
    return sinks.run_report(docs, table(spark, sf_dir, "labels").where("quality = 0").join(docs, "doc_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Für diese Vorschrift wird keine Markierung erzeugt (Anwendungs- oder Verweisungsvorschrift ohne eigenständige Tatbestand-Rechtsfolge-Struktur).'
    ELSE 'Aus 3 unabhängigen Modellläufen und einer Syntaxanalyse zusammengeführt; Übereinstimmung ' || (o_orderkey % 5) * 25 || ' %.' || CASE WHEN o_orderstatus = 'F' THEN ' Die Läufe widersprechen einander; die Markierung ist als unsicher gekennzeichnet.' ELSE '' END
      || CASE WHEN o_orderkey % 3 > 0 THEN ' ' || (o_orderkey % 3) * 25 || ' % der Merkmale sind durch eine amtliche Fundstelle gestützt.' ELSE '' END || ' Automatisch erzeugt und nicht redaktionell geprüft. Keine Rechtsberatung.' END AS hinweis FROM orders""")
def prj05_notes(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "uneinheitlich").otherwise("konsens")
    return o.select("o_orderkey", sinks.note(status, k % 7 != 0, 3, k % 5 * 0.25, k % 3 * 0.25).alias("hinweis"))


_A, _B = (f"lower({span_text(x)})" for x in ("a", "b"))


@query(f"SELECT doc_id, seq, x = y OR (contains(CASE WHEN length(x) < length(y) THEN y ELSE x END, CASE WHEN length(x) < length(y) THEN x ELSE y END) AND least(length(x), length(y)) / greatest(length(x), length(y)) >= 0.7) AS gleich FROM (SELECT doc_id, seq, {_A} AS x, {_B} AS y FROM (SELECT doc_id, seq, line AS a, CASE seq % 4 WHEN 0 THEN ' ' || line || '.' WHEN 1 THEN substr(line, 2) WHEN 2 THEN substr(line, 1, length(line) // 2) ELSE ',' || upper(substr(line, 1, 1)) || substr(line, 2) END AS b FROM ({LINES})))")
def jn09_same_span(spark, sf_dir):
    """Whether a line and a changed copy of it count as the same span."""
    changed = F.expr("CASE seq % 4 WHEN 0 THEN ' ' || line || '.' WHEN 1 THEN substr(line, 2) WHEN 2 THEN substr(line, 1, cast(floor(length(line) / 2) as int)) ELSE ',' || upper(substr(line, 1, 1)) || substr(line, 2) END")
    return lines(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), merging.same_span(F.col("line"), changed).alias("gleich"))


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '', 'g') IN ('building', 'machinery')")
def flt01_select_by_name(spark, sf_dir):
    return relational.select_by_name(table(spark, sf_dir, "customer"), ["c_mktsegment"], ["Buil-ding", "MACHINERY.json"]).select("c_custkey", "c_name")


@query("SELECT event_id, ts IS NOT NULL AND epoch(TIMESTAMP '2024-02-01 00:00:00' - ts) < 30 * 86400 AS frisch FROM events")
def flt03_fresh(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", relational.fresh(F.col("ts").cast("timestamp"), now, 30).alias("frisch"))


@query("SELECT user_id, event_type, epoch_us(max(ts)) // 1000 AS ms FROM events GROUP BY 1, 2 HAVING epoch_us(max(ts)) // 1000 > (SELECT epoch_us(max(ts)) // 1000 FROM events) - 3 * 86400000")
def flt03_fresh_stream(spark, sf_dir):
    """What is fresh, within three days of the newest date, when a stream of all events has been read."""
    events, keys = table(spark, sf_dir, "events"), ["user_id", "event_type"]
    path = new_path(spark, "fresh")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as a stream takes no single file
    incremental.keep_fresh(stream, path, new_path(spark, "fresh-checkpoint"), keys, "ts", 3).awaitTermination()
    return incremental.still_fresh(spark.read.schema(incremental.log_schema(events, keys)).parquet(path), keys)


@query("SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY user_id, event_id LIMIT 100")
def flt06_bud01_budget(spark, sf_dir):
    return relational.within_budget(table(spark, sf_dir, "events"), F.col("event_type") == "purchase", ["user_id", "event_id"], 100).select("event_id")


@query(
    """SELECT event_id, event_id % 5 > 0 AND event_id % 7 > 0 AND verfahren LIKE '%mehrfachlauf%' AND verfahren LIKE '%gegenprobe%' AND laeufe >= 3 AS wiederverwendbar
    FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'syntaxanalyse' WHEN 1 THEN 'syntaxanalyse+mehrfachlauf' ELSE 'syntaxanalyse+mehrfachlauf+gegenprobe' END AS verfahren, event_id % 6 AS laeufe FROM events)"""
)
def flt04_reusable(spark, sf_dir):
    m = F.expr("CASE event_id % 3 WHEN 0 THEN 'syntaxanalyse' WHEN 1 THEN 'syntaxanalyse+mehrfachlauf' ELSE 'syntaxanalyse+mehrfachlauf+gegenprobe' END")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.lit("a").alias("text_hash"), F.when(F.col("event_id") % 5 > 0, "a").otherwise("b").alias("neuer_hash"), F.when(F.col("event_id") % 7 > 0, 3).otherwise(2).alias("format"), m.alias("verfahren"), (F.col("event_id") % 6).alias("laeufe"), F.lit(["m1", "m2"]).alias("modelle"), F.lit("konsens").alias("status"), F.lit(0.5).alias("belegquote"), F.lit(True).alias("beleg_da"),
    )
    return relational.reusable(rows, 3, ["m1"], 3, True).select("event_id", "wiederverwendbar")


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS folge FROM orders GROUP BY 1")
def st02_ordered_spans(spark, sf_dir):
    rows = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda x: x["o_orderkey"].cast("string")), ",").alias("folge"))


@query(
    """SELECT event_id, wirkung, round(CASE wirkung WHEN 'strittig' THEN greatest(0, k - 0.35) WHEN 'entfernt' THEN greatest(0, k - 0.12) ELSE k END, 2) AS konfidenz, CASE WHEN wirkung = 'entfernt' THEN NULL ELSE beleg END AS beleg
    FROM (SELECT event_id, (event_id % 100) / 100.0 AS k, CASE WHEN event_id % 4 > 0 THEN 'b' END AS beleg, CASE WHEN event_id % 4 > 0 THEN CASE event_type WHEN 'view' THEN 'gestuetzt' WHEN 'error' THEN 'strittig' WHEN 'click' THEN 'entfernt' END END AS wirkung FROM events)"""
)
def bp02_apply_probe(spark, sf_dir):
    verdict = F.expr("CASE event_type WHEN 'view' THEN 'stuetzt' WHEN 'error' THEN 'widerspricht' WHEN 'click' THEN 'neutral' END")
    rows = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 100) / F.lit(100.0)).alias("konfidenz"), F.when(F.col("event_id") % 4 > 0, "b").alias("beleg"), verdict.alias("urteil"), F.lit("").alias("stelle"))
    return evidence.apply_probe(rows).select("event_id", "wirkung", F.round("konfidenz", 2).alias("konfidenz"), "beleg")
